"""What larger tables and odd inputs ask of made files, parsers and windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import specimens as S
from tessera.sources import walk as K


def test_made_files_are_dealt_to_all_cores_in_small_batches(spark):
    rows = spark.range(300).select("id", F.lit("a name").alias("name")).coalesce(1)
    files = S.files(rows, "wav", "id", "name")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert [r.k for r in files.orderBy("k").collect()] == list(range(300))
    sizes = S.built(rows.coalesce(1), "id", "name", lambda k, n: bytes(1 << 20)).mapInArrow(lambda batches: ((_counted(b)) for b in batches), "n bigint")
    assert sum(r.n for r in sizes.collect()) == 300 << 20
    both = S.files_of(rows, ["wav", "okt"], "id", "name").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in both} == {"wav": 300, "okt": 300}


def _counted(batch):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([sum(len(v.as_py()) for v in batch.column(1))])], ["n"])


@pytest.mark.parametrize("k", [21_845, 21_846, 65_535, 65_536, 5_400_000, 1 << 40])
def test_numbers_beyond_two_bytes(k):
    fields = lambda kind, build: {t: f for t, _, _, f, _ in K.walk_bytes(build(k, "name"))[1]}
    smus, okt = fields("smus", S.smus), fields("okt", S.okt)
    assert (smus["SHDR"]["tempo"], smus["SHDR"]["volume"], smus["SHDR"]["tracks"], smus["NAME"]["text"]) == (3 * k, 100, k % 5, "name")
    assert okt["SLEN"]["value"] == k and okt["CMOD"]["voices"] == 5 + k % 2


def test_odd_files_do_not_grow_with_their_numbers(spark):
    from tessera.operators import anomalies as A
    from tessera.plans import signals as P

    assert max(len(P._odd(16 * 340_000 + i, "name")) for i in range(16)) < 8192
    assert any(rule == "mp4_mdat_coverage" for rule, *_ in A.findings(P._odd(16 * 340_000 + 13, "name"), "1.x"))


def test_tracker_claims_are_bounded_by_the_file():
    head = bytearray(S.it(3, "name"))
    head[36:38] = b"\xff\xff"
    rows = K.walk_bytes(bytes(head), "it")[1]
    assert len(rows) < len(head) // 4 + 3 and rows[-1][4].startswith("sample table claims 65535 entries")
    assert len(K.walk_bytes(bytes(4096), "it")[1]) == 1


@pytest.mark.parametrize("tail", [b"", b"\x40", bytes(3), b"\x40\0\0\0", b"\xf0" + bytes(7)])
def test_packets_are_whole(tail):
    from tessera.sources.formats import packets

    data = S.midi2(3, "name")[8:]
    got = list(packets(data + tail))
    assert [w for _, words in got[: len(list(packets(data)))] for w in words] == [int.from_bytes(data[i : i + 4], "big") for i in range(0, len(data), 4)]
    assert len(got) == len(list(packets(data)))


def _naive(data):
    """Entropy, share of printable bytes, spread and lag-1 correlation of each window, in whole numbers as far as they go."""
    for start in range(0, len(data) - 1023, 512):
        part = np.frombuffer(data[start : start + 1024], np.int8).astype(object)
        n, total, square = 1024, sum(part), sum(part * part)
        products, ends = sum(part[:-1] * part[1:]), 2 * total - part[0] - part[-1]
        below = n * square - total * total
        yield start, (n * n * products - n * total * ends + (n - 1) * total * total) / (n * below) if below else 0.0, below**0.5 / n


def test_windows_that_could_be_floats_keep_their_bytes_correlation():
    from tessera.operators import signals as G

    waves = [(np.sin(np.arange(2000) / 9)).astype(t).tobytes() for t in ("<f4", ">f4", "<f8", ">f8")]
    noise = np.random.default_rng(1).integers(0, 256, 4096, dtype=np.uint8).tobytes()
    for data in [*waves, noise, bytes(range(256)) * 8, b"a" * 2048, b"=" * 1000 + b"?<>=" * 300]:
        got = list(G.window_features(data))
        assert [r[0] for r in got] == [s for s, *_ in _naive(data)]
        for row, (_, lag1, spread) in zip(got, _naive(data), strict=True):
            assert row[2] == pytest.approx(lag1, abs=1e-6) and row[9] == pytest.approx(spread, abs=1e-6)
    assert all(r[10] and r[6] == r[7] > 0.9 for wave in waves for r in G.window_features(wave))
    assert G._round6(np.array([2.0078125, -2.0078125])).tolist() == [2.007813, -2.007813]


def _slow_wall(x, rate, drop=40.0):
    from tessera.operators import signals as G

    mag = G.spectrogram(x.astype(np.float64))
    freqs = np.fft.rfftfreq(4096, 1 / rate)
    level = 20 * np.log10(np.maximum((mag**2).mean(axis=0) ** 0.5, 1e-9))
    best, at = 0.0, None
    for f in np.geomspace(1000, rate / 2 * 0.98, 240):
        low, high = level[(freqs >= f / 2 ** (1 / 6)) & (freqs < f)], level[(freqs >= f) & (freqs < min(f * 2 ** (1 / 6), rate / 2))]
        if len(low) and len(high) and (step := float(low.mean() - high.mean())) > best:
            best, at = step, float(f)
    return (round(at, 1) if at is not None and best >= drop else None), round(best, 3)


@pytest.mark.parametrize("rate", [8000, 22_050, 48_000])
def test_walls_equal_those_tried_one_by_one(rate):
    from tessera.operators import signals as G

    rng = np.random.default_rng(2)
    cut = np.fft.irfft(np.fft.rfft(rng.normal(0, 3000, 8192)) * (np.arange(4097) < 2000)).astype("<i2")
    for x in (cut, rng.integers(-9000, 9000, 6000).astype("<i2"), np.zeros(5000, "<i2"), (9000 * np.sin(np.arange(9000) / 3)).astype("<i2"), np.empty(0, "<i2")):
        assert G.bandwidth_wall(x, rate) == _slow_wall(x, rate)


def test_geometry_skips_only_readings_that_cannot_be():
    from tessera.operators import signals as G

    wave = np.sin(np.arange(3000) / 9)
    for kind in ("<f4", ">f4", "<f8", ">f8"):
        width, _, order, is_float, confidence, *_ = G.geometry((wave * 0.9).astype(kind).tobytes())
        assert (width, order, is_float) == (int(kind[2]) * 8, "le" if kind[0] == "<" else "be", True) and confidence > 0.9
    assert G.geometry((9000 * wave).astype(">i2").tobytes())[:4] == (16, 1, "be", False)
    assert G.geometry(b"")[:5] == (8, 1, None, False, 0.0) and G.geometry(bytes(64))[4] == 0.0


@pytest.mark.parametrize("bits", [1, 4])
def test_hilbert_cells_equal_those_byte_by_byte(spark, bits):
    from tessera.functions import bytes as Y

    rng = np.random.default_rng(3)
    values = {i: rng.integers(0, 256, n, dtype=np.uint8).tobytes() for i, n in enumerate([0, 1, 3, 4, 255, 256, 257, 1000, 40_001])} | {99: None}
    got = {(r.k, r.cell): (r.x, r.y, r["mean"]) for r in Y.hilbert_cells(spark.createDataFrame(list(values.items()), "k bigint, data binary"), "k", "data", bits).collect()}
    xy = spark.range(1 << 2 * bits).select("id", *[c.alias(n) for c, n in zip(Y.hilbert_xy(bits, F.col("id")), "xy", strict=True)]).collect()
    places, sums = {r.id: (r.x, r.y) for r in xy}, {}
    for k, value in values.items():
        for i, b in enumerate(value or b""):
            sums.setdefault((k, i * (1 << 2 * bits) // len(value)), []).append(b)
    assert got == {(k, c): (*places[c], sum(v) // len(v)) for (k, c), v in sums.items()}


def test_images_measured_together_are_found_as_one_by_one(spark):
    from tessera.operators import locate as L
    from tessera.operators import signals as G
    from tessera.plans import signals as P

    wave = np.sin(np.arange(1500) / 9).astype("<f4").tobytes()
    images = {i: P._image(i, "name") for i in range(30)} | {30: b"", 31: None, 32: b"RIFFORM" + bytes(1100), 33: wave * 400, 34: bytes(700) + wave + bytes(9000), 35: b"\xff" * 1023}
    apart = {k: [s for s, *_ in [(round(x, 12),) for x in G.window_scores([v or b""])[0]]] for k, v in images.items()}
    together = G.window_scores([v or b"" for v in images.values()])
    assert apart == {k: [round(x, 12) for x in s] for k, s in zip(images, together, strict=True)} and len(together[33]) > 2048
    rows = spark.createDataFrame(list(images.items()), "k bigint, content binary")
    got = sorted((r.k, r.kind, r.format, r.start, r.stop) for r in L.located(rows, "k", "content", "aggressive").collect())
    assert {(k, "stream", "mp3") for k in range(30)} <= {r[:3] for r in got} and any(r[:2] == (33, "blob") for r in got)
    seen = G.scores(G.features_of(rows, "k", "content")).select("k", "start", "score").collect()
    assert sorted((r.k, r.start, r.score) for r in seen) == sorted((k, i * G.STEP, round(float(x), 6)) for k, s in zip(images, together, strict=True) for i, x in enumerate(s))

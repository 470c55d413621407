"""The directory index, verbs and repairs over files on disk and at hand."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import extract as E
from tessera.operators import repair as R
from tessera.sources import indexing, walk
from tessera.sources import specimens as S

KINDS = ["wav", "aiff", "flac", "midi", "ogg", "mp3", "mp4", "sf2", "vital", "xm"]


@pytest.fixture()
def folder(tmp_path):
    for i, kind in enumerate(KINDS):
        end, build, _ = S.SPECIMENS[kind]
        (tmp_path / f"{kind}_{i}{end}").write_bytes(build(i + 1, f"name {i}"))
    (tmp_path / "._wav_0.wav").write_bytes(b"junk")
    (tmp_path / "notes.txt").write_bytes(b"text")
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    return tmp_path


def test_index_reads_only_what_changed(spark, folder):
    first, counts = api.index(spark, str(folder))
    assert counts == {"failed": 1, "added": len(KINDS), "updated": 0, "skipped": 0, "pruned": 0}
    rows = {os.path.basename(r.path): r for r in first.collect()}
    assert rows["wav_0.wav"].title == "name 0" and rows["wav_0.wav"].bpm == 100.0 and rows["flac_2.flac"].channels == 2
    assert rows["mp3_5.mp3"].genre == "Hip-Hop" and rows["vital_8.vital"].preset_name == "name 8"
    before = spark.createDataFrame(first.collect(), first.schema)
    end, build, _ = S.SPECIMENS["wav"]
    (folder / "wav_0.wav").write_bytes(build(40, "changed"))
    (folder / "new.wav").write_bytes(build(3, "new"))
    os.remove(folder / "ogg_4.ogg")
    second, counts = api.reindex(spark, str(folder), before)
    assert counts["added"] == 1 and counts["updated"] == 1 and counts["pruned"] == 1 and counts["skipped"] == len(KINDS) - 2
    titles = {os.path.basename(r.path): r.title for r in second.collect()}
    assert titles["wav_0.wav"] == "changed" and "ogg_4.ogg" not in titles and len(titles) == len(KINDS)


def test_verbs(spark, folder):
    files = walk.read_files(spark, str(folder), "*.*").select("path", "content")
    assert {r.verdict for r in api.classify(files).collect()} >= {"single", "opaque"}
    assert api.chunks(files).where("chunk_id = 'fmt '").count() == 1
    assert api.survey(files, ["acid"]).where("chunk_id = 'acid'").first().files == 1
    assert api.scan(files, ["ACID"]).count() == 1
    assert api.dump(files, "bext").first().ascii.startswith("name 0")
    assert api.od(files.where(F.col("path").endswith("wav_0.wav"))).where("chunk_id = 'bext'").count() > 20
    assert api.cover(files).select("mime").distinct().first().mime == "image/png"
    assert {bytes(r.picture) for r in api.cover(files).collect()} >= {b"\x89PNG"}
    assert api.validate(files).where("status = 'ok'").count() >= len(KINDS) - 1
    assert api.carve(files, chunk="INST").count() == 1 and api.carve(files, offset=4, length=2).where("octet_length(part) = 2").count() > 5
    got = api.extract(files).collect()
    assert {r.name for r in got} >= {"data", "name 7", "a sample"} and all(bytes(r.wav)[:4] == b"RIFF" for r in got)
    assert api.features(files).where("size(vector) = 45").count() >= 1
    sections = {r.section for r in api.audit(files).select("section").distinct().collect()}
    assert {"hidden", "provenance", "integrity"} <= sections
    assert {f["format"] for f in api.formats()} >= set(S.SPECIMENS) and all(callable(getattr(api, v)) for v in api.VERBS + api.TOOLS)
    rows = indexing.metadata(files)
    assert "wav" in api.output(api.list_formats(rows), "json") and api.output(api.list_formats(rows), "csv").startswith("format,n\n")
    found = api.query(rows.withColumn("size", F.lit(1)), text="names", limit=3)
    assert found.count() == 3
    with pytest.raises(ValueError):
        api.query(rows, limit="many")


def test_repairs(spark):
    good = S.wav(9, "x")
    cases = {
        "good": good, "size": good[:4] + struct.pack("<I", 3) + good[8:],
        "cue": good.replace(b"cue " + struct.pack("<II", 52, 2), b"cue " + struct.pack("<II", 52, 9)),
        "flac": S.flac(2, "x").replace(b"\x81\0\0\x14", b"\x01\0\0\x14"),
        "mp4": S.mp4(2, "x"), "empty": b"", "noise": bytes(range(256)),
    }
    files = spark.createDataFrame(list(cases.items()), "path string, content binary")
    status = {r.path: r.status for r in api.validate(files).collect()}
    assert status["good"] == status["empty"] == status["noise"] == "ok"
    assert {k for k, v in status.items() if v == "violated"} == {"size", "cue", "flac", "mp4"}
    assert R.mended(cases["size"]) == good and R.mended(good) == good
    assert R.mended(cases["cue"]) == cases["cue"].replace(struct.pack("<II", 52, 9), struct.pack("<II", 52, 2))
    assert R.mended(cases["flac"]) == S.flac(2, "x")
    again = files.withColumn("content", R.repaired(F.col("content")))
    left = {r.path for r in api.validate(again).where("status <> 'ok'").collect()}
    assert left <= {"mp4"}
    order = R.order_of(good)
    nodes, rest = R.parse(good, order)
    assert b"".join(n.emit(order) for n in nodes) + rest == good


def test_edits_keep_samples(spark):
    for build, texts in ((S.wav, ("INAM", "IART")), (S.aiff, ("NAME", "AUTH"))):
        data = build(9, "old")
        out = R.edited(data, {"title": "new title", "artist": "someone", "comment": None})
        kind, rows = walk.walk_bytes(out)
        words = [str(v) for *_, f, w in rows for v in f.values()]
        assert "new title" in words and "someone" in words and not any(w for *_, w in rows)
        body = lambda x: [x[at + 8 : at + 8 + n] for t, at, n, *_ in walk.walk_bytes(x)[1] if t in ("data", "SSND")]
        assert body(out) == body(data) == body(R.stripped(data)) and len(R.stripped(data)) < len(data)
    with pytest.raises(ValueError):
        R.edited(S.wav(1, "x"), {"shoe size": "9"})
    files = spark.createDataFrame([("a", S.wav(3, "x")), ("b", b"no")], "path string, content binary")
    assert [r.content is None for r in api.write(files, {"title": "t"}).orderBy("path").collect()] == [False, True]


def test_layouts_and_carving(spark):
    data = S.wt(4, "x")
    files = spark.createDataFrame([("a", data)], "path string, content binary")
    row = E.carve_struct(files, "@4 samples:u32 frames:u16 @0 magic:bytes:4").first()
    assert (row.samples, row.frames, row.magic) == (8, 5, b"vawt".hex())
    layout = [{"name": "magic", "type": "bytes:4", "at": 0}, {"name": "samples", "type": "u32"}, {"name": "frames", "type": "u16", "after": "samples"}, {"name": "flags", "type": "u16", "names": {4: "int16"}}]
    assert tuple(files.select(*E.compiled(layout)).first()) == (b"vawt".hex(), 8, 5, "int16")
    regions = spark.createDataFrame([("a", 0, 4), ("a", 8, 10)], "path string, start bigint, stop bigint")
    assert sorted(bytes(r.part) for r in E.carve_regions(files, regions).collect()) == [b"\x05\0", b"vawt"]

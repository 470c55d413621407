"""Byte functions, walkers and ordered operators on small inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import bytes as Y
from tessera.operators import ordered as R
from tessera.functions.sniffing import mpeg_header
from tessera.sources import audio
from tessera.sources import specimens as S
from tessera.sources import walk as K
from tessera.sources.chunks import iff


def wav(*chunks, form=b"WAVE"):
    body = b"".join(t + struct.pack("<I", len(p)) + p + b"\0" * (len(p) % 2) for t, p in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + form + body


FMT = (b"fmt ", struct.pack("<HHIIHH", 1, 1, 44100, 88200, 2, 16))


def ids(data):
    return [c[0] for c in K.walk_bytes(data)[1]]


def test_wav():
    acid = (b"acid", struct.pack("<IHHfIHHf", 0, 60, 0, 0.0, 4, 4, 4, 120.0))
    kind, chunks = K.walk_bytes(wav(FMT, acid, (b"data", b"\1\2" * 441)))
    assert kind == "wav" and [c[0] for c in chunks] == ["fmt ", "acid", "data"]
    assert chunks[1][3]["tempo"] == 120.0 and chunks[2][3] == {"frames": 441, "duration": 0.01}
    assert ids(wav(FMT, (b"data", b"abc"), (b"LIST", b"INFO"))) == ["fmt ", "data", "LIST"]


@pytest.mark.parametrize("cut", [0, 1, 11, 12, 19, 30, 44, 45])
def test_damage_never_raises(cut):
    whole = wav(FMT, (b"data", b"x" * 100))
    K.walk_bytes(whole[:cut])
    for kind in K.PARSERS:
        K.walk_bytes(whole[:cut], kind)
        K.walk_bytes(bytes(range(256)) * 3, kind)


def test_overrun_is_told():
    data = wav(FMT, (b"data", b"x" * 100))[:-10]
    warnings = [c[4] for c in K.walk_bytes(data)[1] if c[4]]
    assert any("claims 100 bytes, 90 are left" in w for w in warnings) and any("RIFF size" in w for w in warnings)


def test_other_formats():
    comm = struct.pack(">hIh", 2, 44100, 16) + struct.pack(">HQ", 16398, 44100 << 48)
    aiff = b"FORM" + struct.pack(">I", 30) + b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm
    assert K.walk_bytes(aiff)[1][0][3]["duration"] == 1.0
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + ((44100 << 44) | (1 << 41) | (15 << 36) | 1000).to_bytes(8, "big") + b"\0" * 16
    flac = K.walk_bytes(b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info)[1][0]
    assert (flac[3]["sample_rate"], flac[3]["channels"], flac[3]["bits_per_sample"], flac[3]["total_samples"]) == (44100, 2, 16, 1000)
    events = b"\0\xff\x51\x03\x07\xa1\x20" + b"\0\x90\x3c\x40\x60\x3c\0" + b"\0\xff\x2f\0"
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(events)) + events
    assert K.walk_bytes(midi)[1][1][3] == {"events": 4, "notes": 1, "ticks": 96, "tempo": 120.0}
    box = lambda t, p: struct.pack(">I", 8 + len(p)) + t + p
    assert ids(box(b"ftyp", b"M4A ") + box(b"moov", box(b"mvhd", b"\0" * 4))) == ["ftyp", "moov", "mvhd"]
    page = b"OggS\0\2" + struct.pack("<qIIIB", 5, 7, 0, 0, 1) + b"\3abc"
    assert K.walk_bytes(page * 2)[1][1][1:3] == (31, 31)
    assert mpeg_header(bytes.fromhex("fffb9064"))["length"] == 417 and mpeg_header(b"\xff\xff\xff\xff") is None
    assert ids(b"XXXX" + b"\0" * 4 + b"AAAA" + struct.pack(">I", 4) + b"1234" + b"BBBB" + struct.pack(">I", 2) + b"12") == ["AAAA", "BBBB"]


def test_walk_and_survey(spark):
    files = spark.createDataFrame([("a", wav(FMT, (b"data", b"xy"))), ("b", wav(FMT, (b"data", b"xy"), (b"data", b"zz"))), ("c", None)], "path string, content binary")
    chunks = K.walk(files)
    assert {r.chunk_id: (r.files, r.example) for r in K.survey(chunks).collect()} == {"fmt ": (2, "a"), "data": (2, "a")}
    assert {r.chunk_id: r.chunks for r in K.census(chunks).collect()} == {"fmt ": 2, "data": 3}


def test_bytes(spark):
    df = spark.createDataFrame([(1, bytes([0xFF, 0xFE, 0x80, 1, 0xFF, 0xFE])), (2, b"")], "id int, data binary")
    x = F.col("data")
    row = df.where("id = 1").select(Y.read_typed(x, 0, "i16"), Y.read_typed(x, 0, "u24", True), Y.read_typed(x, 5, "u16"), Y.synchsafe(x, 2), Y.bitfield(F.lit(0b110100), 2, 3)).first()
    assert tuple(row) == (-257, 0xFFFE80, None, ((0 * 128 + 1) * 128 + 127) * 128 + 126, 0b101)
    assert sorted(r.offset for r in Y.find_all(df, "id", "data", b"\xff\xfe").collect()) == [0, 4]
    assert [r.entropy for r in Y.entropy(Y.byte_counts(df, "id", "data"), "id").collect()] == [pytest.approx(1.918296)]
    cells = {tuple(r) for r in spark.range(16).select(*Y.hilbert_xy(2, F.col("id"))).collect()}
    assert len(cells) == 16 and cells == {(a, b) for a in range(4) for b in range(4)}


def test_ordered(spark):
    spans = spark.createDataFrame([("k", 0, 5), ("k", 3, 9), ("k", 20, 21), ("j", 1, 2)], "key string, start long, stop long")
    assert sorted(map(tuple, R.islands(spans, ["key"], "start", "stop", 4).collect())) == [("j", 1, 2, 1), ("k", 0, 9, 2), ("k", 20, 21, 1)]
    extents = spark.createDataFrame([("k", 0, 3), ("k", 6, 9)], "key string, start long, stop long")
    assert sorted(map(tuple, R.absorbed(spans, extents, ["key"], cell=4).collect())) == [("k", 0, 5), ("k", 3, 9)]
    at = spark.createDataFrame([("k", 4), ("k", 100)], "key string, t long")
    marks = spark.createDataFrame([("k", 1), ("k", 6)], "key string, m long")
    assert sorted(map(tuple, R.nearest(at, marks, ["key"], "t", "m", 10).collect())) == [("k", 4, 6), ("k", 100, None)]


def test_many_chunks():
    """Every step goes on by eight bytes or more, so no number of chunks ends a walk."""
    n = 100_003
    assert sum(1 for _ in iff(b"RIFF" + bytes(8) + (b"junk" + bytes(4)) * n, "little")) == n
    assert sum(1 for _ in audio.midi((b"MThd" + struct.pack(">IHHH", 6, 1, 1, 96)) + (b"XXXX" + bytes(4)) * n)) >= n
    assert sum(1 for _ in K.generic(b"GRIDxxxx" + (b"abcd" + struct.pack("<I", 2) + b"zz") * n)) == n


@pytest.mark.parametrize("kind", sorted(S.SPECIMENS))
def test_damaged_specimens_never_raise(kind):
    """Whatever is cut off or overwritten, a walk ends and tells what it could read."""
    end, build, _ = S.SPECIMENS[kind]
    data = build(17, "a name")
    for cut in range(0, len(data), max(1, len(data) // 25)):
        K.walk_bytes(data[:cut], kind, "/x" + end)
        K.walk_bytes(data[:cut] + b"\xff" * 64 + data[cut + 64 :], kind, "/x" + end)
        K.walk_bytes(data[:cut] + bytes(64) + data[cut + 64 :], None, "/x" + end)

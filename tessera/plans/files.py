"""Queries over whole files: metadata, violations and repairs, edits, samples and cuts, and the SQL that says what must come out."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import codecs as C
from tessera.operators import extract as E
from tessera.operators import repair as R
from tessera.sources import bindings as B
from tessera.sources import indexing
from tessera.sources import specimens as S
from tessera.sources import walk as K

QUERIES, ORACLES = {}, {}
_ROWS = "(SELECT c_custkey AS k, c_name AS name FROM customer)"
_RATE = "8000 + 100 * (k % 400)"


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


def _made(spark, d, build):
    rows = S.built(B.table(spark, d, "customer"), "c_custkey", "c_name", build)
    return rows.select(F.col("k").cast("string").alias("path"), "content")


def _k():
    return F.col("path").cast("bigint").alias("k")


@query(f"SELECT k, 'wav' AS format, name AS title, 100.0::DOUBLE AS bpm, ({_RATE})::INT AS sample_rate, 1 AS channels, 16 AS bits_per_sample, nullif(k % 128, 0)::INT AS root_note, k % 16 AS acid_beats, 'an artist' AS artist, round(k / ({_RATE}), 6) AS duration FROM {_ROWS}")
def indexed_metadata(spark, d):
    files = S.files(B.table(spark, d, "customer"), "wav", "c_custkey", "c_name")
    rows = indexing.metadata(files)
    return rows.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), "format", "title", "bpm", "sample_rate", "channels", "bits_per_sample", "root_note", "acid_beats", "artist", "duration")


_PRESETS = {"vital": ("preset_name", "'someone'", "name"), "serum": ("preset_name", "NULL", "name"), "ni": ("preset_name", "NULL", "substr(name, 1, 31)"), "multisample": ("preset_name", "'someone'", "name"), "xpm": ("preset_name", "NULL", "name"), "xtd": ("preset_name", "NULL", "name")}


@query(" UNION ALL ".join(f"SELECT k, '{kind}' AS format, {name} AS preset_name, {creator} AS creator FROM {_ROWS}" for kind, (_, creator, name) in _PRESETS.items()))
def preset_metadata(spark, d):
    out = None
    for kind in _PRESETS:
        files = S.files(B.table(spark, d, "customer"), kind, "c_custkey", "c_name")
        rows = indexing.metadata(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), "format", "preset_name", "creator")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT k, format, title FROM {_ROWS}, (VALUES ('flac'), ('ogg'), ('mp3'), ('mp4'), ('aiff'), ('mod')) v(format), LATERAL (SELECT CASE WHEN format = 'mod' THEN substr(name, 1, 20) ELSE name END AS title)")
def tagged_titles(spark, d):
    out = None
    for kind in ("flac", "ogg", "mp3", "mp4", "aiff", "mod"):
        files = S.files(B.table(spark, d, "customer"), kind, "c_custkey", "c_name")
        rows = indexing.metadata(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), "format", "title")
        out = rows if out is None else out.unionByName(rows)
    return out


def _wrong(k: int, name: str) -> bytes:
    """Files with one thing wrong, or none."""
    good = S._riff(b"WAVE", S._fmt(k), S._chunk(b"data", S._pcm(k)))
    looped = struct.pack("<9I", 0, 0, 1, 60, 0, 0, 0, 5, 0) + bytes(24)
    flac = S.flac(k, name)
    moved = S.mp4(k, name)
    return [good, good[:4] + struct.pack("<I", k) + good[8:], S._riff(b"WAVE", S._fmt(k), S._chunk(b"smpl", looped), S._chunk(b"data", S._pcm(k))), flac.replace(b"\x81\0\0\x14", b"\x01\0\0\x14"), S._form(b"8SVX", S._chunk(b"BODY", b"abcd", ">"))[:4] + bytes(4) + S._form(b"8SVX", S._chunk(b"BODY", b"abcd", ">"))[8:], moved][k % 6]


@query(f"SELECT k, ['iff', 'counts', 'flac', 'iff', 'mp4'][k % 6] AS repairer, [k, 5, 1, 0, k][k % 6] AS stored, [36 + {2} * (k % 50 + 1), 1, 129, 16, NULL][k % 6] AS computed, k % 6 <> 5 AS repairable FROM {_ROWS} WHERE k % 6 BETWEEN 1 AND 4")
def file_violations(spark, d):
    rows = R.analysed(_made(spark, d, _wrong)).where("path % 6 <> 5")
    return rows.select(_k(), "repairer", "stored", "computed", "repairable")


@query(f"SELECT k, 'ok' AS status FROM {_ROWS} WHERE k % 6 <> 5")
def repaired_files(spark, d):
    files = _made(spark, d, _wrong).where("path % 6 <> 5")
    mended = files.withColumn("content", R.repaired(F.col("content")))
    return R.validated(mended).select(_k(), "status")


def _off(k: int, name: str) -> bytes:
    """An MP4 whose one chunk offset is too large."""
    full = lambda tag, body: S._box(tag, b"\0\0\0\0" + body)
    table = S._box(b"stbl", full(b"stco", struct.pack(">II", 1, 100_000 + k)))
    return S._box(b"ftyp", b"M4A " + bytes(4)) + S._box(b"moov", S._box(b"trak", S._box(b"mdia", S._box(b"minf", table)))) + S._box(b"mdat", S._pcm(k))


@query(f"SELECT k, 100000 + k AS stored, (16 + 8 * 5 + 20 + 8)::BIGINT AS computed, true AS mended FROM {_ROWS}")
def moved_offsets(spark, d):
    files = _made(spark, d, _off)
    before = R.analysed(files).where("repairer = 'mp4'").select(_k(), "stored", "computed")
    after = R.validated(files.withColumn("content", R.repaired(F.col("content")))).select(_k(), (F.col("status") == "ok").alias("mended"))
    return before.join(after, "k")


@query(f"SELECT k, format, 'new ' || k AS title, {2} * (k % 50 + 1) AS data FROM {_ROWS}, (VALUES ('wav'), ('aiff')) v(format)")
def edited_files(spark, d):
    out = None
    for kind, ids in (("wav", "('LIST', 'data')"), ("aiff", "('NAME', 'SSND')")):
        files = S.files(B.table(spark, d, "customer"), kind, "c_custkey", "c_name")
        title = "INAM" if kind == "wav" else "text"
        new = files.select("path", _retitled(F.col("content"), F.col("k")).alias("content"))
        chunks = K.walk(new).where(f"chunk_id in {ids}")
        k = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k")
        text = F.max(F.when(F.col("chunk_id").isin("LIST", "NAME"), F.col("fields")[title]))
        size = F.max(F.when(F.col("chunk_id").isin("data", "SSND"), F.col("size") - (8 if kind == "aiff" else 0)))
        part = chunks.groupBy(k).agg(F.lit(kind).alias("format"), text.alias("title"), size.alias("data"))
        out = part if out is None else out.unionByName(part)
    return out


def _retitled(content, k):
    @F.pandas_udf("binary")
    def run(values: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([R.edited(bytes(v), {"title": f"new {n}"}) for v, n in zip(values, ks, strict=True)])

    return run(content, k)


@query(f"SELECT k, 'sf2' AS format, substr(name, 1, 20) AS name, ({_RATE})::INT AS rate, (k % 50 + 1) AS samples FROM {_ROWS} WHERE k + 8 >= k % 50 + 1 UNION ALL SELECT k, 'vag', substr(name, 1, 16), ({_RATE})::INT, 28 * (k % 9) FROM {_ROWS} UNION ALL SELECT k, 'gf1pat', substr(name, 1, 7), ({_RATE})::INT, k % 50 + 1 FROM {_ROWS} UNION ALL SELECT k, 'xm', 'a sample', 8363, k % 30 + 1 FROM {_ROWS} UNION ALL SELECT k, 'wav', 'data', ({_RATE})::INT, k % 50 + 1 FROM {_ROWS}")
def extracted_samples(spark, d):
    """Of SoundFonts the header claims more samples than there are: what is there is taken."""
    out = None
    for kind in ("sf2", "vag", "gf1pat", "xm", "wav"):
        files = S.files(B.table(spark, d, "customer"), kind, "c_custkey", "c_name")
        rows = E.samples(files)
        n = F.least(F.octet_length("pcm") / 2, F.lit(10_000)).cast("bigint")
        k = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint")
        if kind == "sf2":
            n = F.least(n, k % 50 + 1)
            rows = rows.where(k + 8 >= k % 50 + 1)
        part = rows.select(k.alias("k"), F.lit(kind).alias("format"), "name", "rate", n.alias("samples"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT k, 8::BIGINT AS samples, (k % 30 + 1)::BIGINT AS frames, lower(hex(encode('vawt'))) AS magic FROM {_ROWS}")
def declared_layouts(spark, d):
    files = S.files(B.table(spark, d, "customer"), "wt", "c_custkey", "c_name")
    layout = [{"name": "magic", "type": "bytes:4", "at": 0}, {"name": "samples", "type": "u32"}, {"name": "frames", "type": "u16"}]
    return files.select("k", *E.compiled(layout))


@query(f"SELECT k, 8::BIGINT AS samples, (k % 30 + 1)::BIGINT AS frames FROM {_ROWS}")
def carved_structs(spark, d):
    files = S.files(B.table(spark, d, "customer"), "wt", "c_custkey", "c_name")
    return E.carve_struct(files, "@4 samples:u32 frames:u16").select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), "samples", "frames")


@query(f"SELECT k, i * 4 AS start, i * 4 + 3 AS stop, hex(encode(substr(name, i * 4 + 1, 3))) AS part FROM {_ROWS}, range(3) r(i)")
def carved_regions(spark, d):
    files = _made(spark, d, lambda k, n: n.encode())
    regions = files.select("path", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 4, 8)])).alias("start")).withColumn("stop", F.col("start") + 3)
    return E.carve_regions(files, regions).select(_k(), "start", "stop", F.hex("part").alias("part"))


@query(f"SELECT k, 'image/png' AS mime, '89504E47' AS picture FROM {_ROWS}")
def cover_pictures(spark, d):
    files = S.files(B.table(spark, d, "customer"), "flac", "c_custkey", "c_name")
    return E.covers(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), "mime", F.hex("picture").alias("picture"))


@query(f"SELECT k, octet_length(encode(name))::INT + 44 AS n_bytes, hex(encode(substr(name, 2, 1))) || hex(encode(substr(name, 1, 1))) AS first, 8000::BIGINT AS rate FROM {_ROWS}")
def wrapped_samples(spark, d):
    """Big-endian samples in a WAV file."""
    files = _made(spark, d, lambda k, n: n.encode())
    w = files.select("path", C.wrapped(F.col("content"), 8000, big_endian=True).alias("w"))
    return w.select(_k(), F.octet_length("w").alias("n_bytes"), F.hex(F.substring("w", 45, 2)).alias("first"), E.decode_value(F.col("w"), "u32", 24).alias("rate"))


@query(f"SELECT k, (k % 9) AS notes, 480::BIGINT * (k % 9) AS ticks, 90.0::DOUBLE AS tempo FROM {_ROWS} WHERE k % 9 > 0")
def written_midi(spark, d):
    """Notes of a beat each, written as MIDI files and walked."""
    files = _made(spark, d, lambda k, n: C.notes_to_smf([(60 + i, float(i), 1.0, 90) for i in range(k % 9)], 90)).where("path % 9 > 0")
    tracks = K.walk(files).where("chunk_id = 'MTrk'")
    return tracks.select(_k(), F.col("fields")["notes"].cast("bigint").alias("notes"), F.col("fields")["ticks"].cast("bigint").alias("ticks"), F.col("fields")["tempo"].cast("double").alias("tempo"))


@query(f"SELECT k, 24 AS bits, 24 - 8 * (k % 2)::INT AS effective_bits, k % 2 = 1 AS padded FROM {_ROWS}")
def sample_integrity(spark, d):
    def build(k, n):
        body = b"".join((i * 256 if k % 2 else i * 256 + 1).to_bytes(3, "little") for i in range(1, 1200))
        return S._riff(b"WAVE", S._chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 24_000, 3, 24)), S._chunk(b"data", body))

    return api.integrity(_made(spark, d, build)).select(_k(), "bits", "effective_bits", "padded")


@query("SELECT library, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM (SELECT l_suppkey % 5 AS library, l_orderkey AS size FROM lineitem) GROUP BY 1")
def streamed_census(spark, d):
    """Counts whose partial states a stream keeps from batch to batch."""
    from tessera import streaming

    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    sums = rows.groupBy((F.col("l_suppkey") % 5).alias("library")).agg(F.count("*").cast("bigint").alias("files"), F.sum("l_orderkey").cast("bigint").alias("bytes"))
    return streaming.drained(sums, "complete", "census")



def _wave_nibbles(n: int) -> list[int]:
    import math

    return [round(6 * math.sin(2 * math.pi * i / 64)) & 15 for i in range(n)]


def _snes(k: int, name: str) -> bytes:
    """A ROM with one sound of k % 5 + 20 blocks at 0x1000."""
    rom = bytearray(S.snesrom(k, name))
    blocks = k % 5 + 20
    codes = _wave_nibbles(16 * blocks)
    for b in range(blocks):
        head = (9 if b % 2 else 10) << 4 | (1 if b == blocks - 1 else 0)
        part = codes[16 * b : 16 * b + 16]
        rom[0x1000 + 9 * b : 0x1009 + 9 * b] = bytes([head]) + bytes(part[2 * i] << 4 | part[2 * i + 1] for i in range(8))
    return bytes(rom)


def _n64(k: int, name: str) -> bytes:
    """A ROM with a codebook of two predictors, the first of them empty, and k % 5 + 40 frames behind it."""
    frames = k % 5 + 40
    codes = _wave_nibbles(16 * frames)
    body = b"".join(bytes([11 << 4]) + bytes(codes[16 * f + 2 * i] << 4 | codes[16 * f + 2 * i + 1] for i in range(8)) for f in range(frames))
    return S.n64rom(k, name) + bytes(36) + struct.pack(">II", 2, 2) + bytes(32) + b"\0\1" * 16 + body + b"\xff" * 64


@query(f"SELECT k, 'snes' AS rom, '001000' AS name, 16 * (k % 5 + 20) AS samples FROM (SELECT n_nationkey::BIGINT AS k FROM nation) UNION ALL SELECT k, 'n64', printf('%06x', 68 + 36 + 8 + 64), 16 * (k % 5 + 40) FROM (SELECT n_nationkey::BIGINT AS k FROM nation)")
def ripped_samples(spark, d):
    """Sounds that nothing in a ROM points at."""
    out = None
    for rom, build, end in (("snes", _snes, ".sfc"), ("n64", _n64, ".z64")):
        rows = S.built(B.table(spark, d, "nation"), "n_nationkey", "n_name", build)
        files = rows.select(F.concat(F.lit(f"/{rom}/"), "k", F.lit(end)).alias("path"), "content")
        found = E.samples(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("k"), F.lit(rom).alias("rom"), "name", (F.octet_length("pcm") / 2).cast("bigint").alias("samples"))
        out = found if out is None else out.unionByName(found)
    return out

"""A catalogue filled from files: only what is new or changed is read, what is gone is pruned."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import music
from tessera.functions.bytes import each_value
from tessera.functions.values import note_class
from tessera.operators import catalogue
from tessera.sources import walk

#: Endings of names that are indexed.
ENDINGS = [".wav", ".aif", ".aiff", ".aifc", ".flac", ".ogg", ".mp3", ".m4a", ".mp4", ".mid", ".midi", ".rmi", ".sf2", ".8svx", ".mod", ".xm", ".s3m", ".it", ".fxp", ".rx2", ".ncw", ".vital", ".serumpreset", ".nksf", ".bwpreset", ".als", ".adg", ".adv", ".alc", ".agr", ".asd", ".amxd", ".wt", ".multisample", ".snd", ".pgm", ".xpm", ".xpn", ".xtd", ".mpcpattern"]
#: Where each format keeps what the catalogue has columns for: (chunk, field), the first that is there.
PLACES = {
    "title": [("LIST", "INAM"), ("NAME", "text"), ("VORBIS_COMMENT", "TITLE"), ("tags", "TITLE"), ("TIT2", "text"), ("TT2", "text"), ("hex:a96e616d", "title"), ("ID3v1", "title"), ("MTrk", "name"), ("INAM", "text"), ("XM", "title"), ("MOD", "title"), ("IMPM", "title"), ("SCRM", "title")],
    "artist": [("LIST", "IART"), ("AUTH", "text"), ("VORBIS_COMMENT", "ARTIST"), ("tags", "ARTIST"), ("TPE1", "text"), ("hex:a9415254", "artist"), ("ID3v1", "artist"), ("cart", "artist")],
    "album": [("LIST", "IPRD"), ("VORBIS_COMMENT", "ALBUM"), ("tags", "ALBUM"), ("TALB", "text"), ("hex:a9616c62", "album"), ("ID3v1", "album")],
    "genre": [("LIST", "IGNR"), ("VORBIS_COMMENT", "GENRE"), ("tags", "GENRE"), ("TCON", "text"), ("hex:a967656e", "genre")],
    "comment": [("LIST", "ICMT"), ("ANNO", "text"), ("VORBIS_COMMENT", "COMMENT"), ("COMM", "text"), ("hex:a9636d74", "comment")],
    "duration": [("data", "duration"), ("COMM", "duration"), ("frames", "duration"), ("clip", "duration"), ("SND", "duration")],
    "bpm": [("acid", "tempo"), ("TBPM", "text"), ("tmpo", "bpm"), ("VORBIS_COMMENT", "BPM"), ("MTrk", "tempo"), ("XM", "bpm"), ("meta", "tempo_value")],
    "key": [("TKEY", "text"), ("VORBIS_COMMENT", "INITIALKEY"), ("VORBIS_COMMENT", "KEY")],
    "sample_rate": [("fmt ", "sample_rate"), ("COMM", "sample_rate"), ("STREAMINFO", "sample_rate"), ("ident", "sample_rate"), ("frames", "sample_rate"), ("stsd", "sample_rate"), ("VHDR", "sample_rate"), ("NCW", "sample_rate")],
    "channels": [("fmt ", "channels"), ("COMM", "channels"), ("STREAMINFO", "channels"), ("ident", "channels"), ("frames", "channels"), ("stsd", "channels"), ("NCW", "channels")],
    "bits_per_sample": [("fmt ", "bits_per_sample"), ("COMM", "bits_per_sample"), ("STREAMINFO", "bits_per_sample"), ("NCW", "bits_per_sample")],
    "root_note": [("smpl", "midi_unity_note"), ("inst", "base_note"), ("acid", "root_note"), ("INST", "base_note")],
    "acid_beats": [("acid", "num_beats")],
    "preset_name": [("CcnK", "preset_name"), ("json", "presetName"), ("vital", "preset_name"), ("NISI", "name"), ("meta", "preset_name"), ("multisample.xml", "name"), ("program", "program_name"), ("xtd", "name"), ("expansion", "title")],
    "device": [("meta", "device_name"), ("CcnK", "plugin_id")],
    "creator": [("json", "presetAuthor"), ("vital", "author"), ("NISI", "author"), ("meta", "creator"), ("multisample.xml", "creator"), ("expansion", "manufacturer")],
    "category": [("vital", "preset_style"), ("meta", "device_category"), ("multisample.xml", "category")],
    "product": [("json", "product"), ("NISI", "product"), ("expansion", "title")],
}
#: For each place, the columns that it may fill and how early it stands among their places.
_RANKS = {p: [(i, places.index(p)) for i, places in enumerate(PLACES.values()) if p in places] for p in {p for places in PLACES.values() for p in places}}
_TAGS = {tag for tag, _ in _RANKS}
NUMBERS = {"duration": "double", "bpm": "double", "sample_rate": "int", "channels": "int", "bits_per_sample": "int", "root_note": "int", "acid_beats": "bigint"}
_SCHEMA = "format string, chunks string, " + ", ".join(f"{c} string" for c in PLACES)


def metadata(files: DataFrame) -> DataFrame:
    """A row a file with what its chunks say: format, ids of chunks, and the catalogue's columns. Files that nothing is known of have no format.

    A tempo or key that no chunk has comes from the name; a key also from a root note. A root note of 0 says that there is none.
    """

    def made(data: bytes, name: bytes) -> Iterator[tuple]:
        kind, rows = walk.walk_bytes(data, None, name.decode("utf-8", "replace"))
        told: list[str | None] = [None] * len(PLACES)
        ranks = [len(_RANKS)] * len(PLACES)
        for tag, _, _, fields, _ in rows:
            if tag in _TAGS:
                for k, v in fields.items():
                    for column, rank in _RANKS.get((tag, k), ()):
                        if rank < ranks[column] and v is not None and (text := str(v)) != "":
                            told[column], ranks[column] = text, rank
        ids = ",".join(dict.fromkeys(tag.strip() for tag, *_ in rows if tag != "warning"))
        yield kind, ids, *told

    rows = files.select("path", "content", F.encode("path", "UTF-8").alias("_name"))
    out = each_value(rows, ["path"], ["content", "_name"], _SCHEMA, made)
    out = out.withColumns({c: F.col(c).try_cast("double").cast(t) for c, t in NUMBERS.items()})
    bpm = F.coalesce(F.when(F.col("bpm") > 0, F.round("bpm", 3)), music.bpm_from_filename(F.col("path")).cast("double"))
    note = F.nullif("root_note", F.lit(0))
    key = F.coalesce("key", music.key_from_path(F.col("path")), note_class(note))
    return out.withColumns({"bpm": bpm, "key": key, "root_note": note})


def listing(spark: SparkSession, root: str, endings: list[str] | None = None) -> DataFrame:
    """``path``, ``size`` and ``mtime`` of the files below a root that may be indexed; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return found.where(~walk.junk(F.regexp_extract("path", r"([^/]*)$", 1)) & ending.isin(endings or ENDINGS))


def changed(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Files that the catalogue doesn't have with this size and time."""
    return now if before is None else now.join(before.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def index(spark: SparkSession, root: str, before: DataFrame | None = None, seen: Column | None = None, endings: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A new snapshot of a library, and how many files were added, updated, skipped, failed and pruned.

    Files that didn't change aren't opened. Rows of files that are gone go; rows that aren't below the root stay.
    """
    from tessera.sources.scratch import materialise

    now = materialise(listing(spark, root, endings), "listing")
    fresh = materialise(changed(now, before).select("path", "size", "mtime"), "changed")
    wanted = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").join(fresh.select("path"), "path", "left_semi")
    stamped = seen if seen is not None else F.current_timestamp()
    rows = metadata(wanted).join(fresh, "path").withColumns({"last_seen_at": stamped, "indexed_at": stamped})
    rows = materialise(rows, "indexed")
    counts = {"failed": rows.where("format is null").count()}
    good = rows.where("format is not null")
    if before is None:
        return good, counts | {"added": good.count(), "updated": 0, "skipped": 0, "pruned": 0}
    known = before.select("path")
    counts |= {"added": good.join(known, "path", "left_anti").count(), "updated": good.join(known, "path", "left_semi").count(), "skipped": now.count() - fresh.count()}
    below = F.col("path").startswith(now.agg(F.min(F.regexp_extract("path", r"^[a-z]+:", 0))).first()[0] or "") & F.col("path").contains(root.rstrip("/") + "/")
    gone = before.where(below).join(now.select("path"), "path", "left_anti")
    counts["pruned"] = gone.count()
    kept = before.join(gone.select("path"), "path", "left_anti").select(*good.columns)
    return catalogue.upsert(kept, good), counts


def import_tags(text: str, spark: SparkSession) -> DataFrame:
    """Tags of a legacy JSON object of paths with lists of tags."""
    rows = [(json.dumps({k: v}),) for k, v in json.loads(text).items()]
    return catalogue.tags_from_json(spark.createDataFrame(rows, "value string"))

"""Every verb and tool as a function over DataFrames: thin names for the operators, so that a user finds them.

``files`` has ``path`` and ``content`` (``walk.read_files`` reads them); ``rows`` is a catalogue as ``index`` makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytes as Y
from tessera.functions import codecs, music
from tessera.functions import values as V
from tessera.operators import anomalies, extract as samples_of, locate as locating, repair as mending, search, signals
from tessera.operators import catalogue as C
from tessera.operators import text as X
from tessera.sources import indexing, walk
from tessera.sources.formats import PARSERS as _FORMATS

# Files


def inspect(files: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None, fmt: str | None = None) -> DataFrame:
    """Chunks of each file with their decoded fields."""
    return C.select_chunks(walk.walk(files, forced=fmt), only, exclude)


def chunks(files: DataFrame) -> DataFrame:
    return inspect(files).select("path", "ordinal", "chunk_id", "offset", "size", "fields")


def info(files: DataFrame) -> DataFrame:
    """What the catalogue would hold of each file."""
    return indexing.metadata(files)


def classify(files: DataFrame) -> DataFrame:
    """Verdict, format and next verb of each file."""
    return locating.triaged(files)


def census(files: DataFrame) -> DataFrame:
    return walk.census(walk.walk(files))


def survey(files: DataFrame, has: list[str] | None = None) -> DataFrame:
    rows = walk.walk(files)
    return walk.survey(rows.join(C.having_chunks(rows, has), "path", "left_semi") if has else rows)


def shape(files: DataFrame) -> DataFrame:
    return walk.shapes(walk.walk(files))


def dump(files: DataFrame, chunk: str, most: int = 4096) -> DataFrame:
    """Hex rows of the first chunk of an id in each file."""
    at = C.resolve_address(walk.walk(files), chunk)
    part = files.select("path", "content").join(at, "path").select("path", F.substring("content", (F.col("offset") + 1).cast("int"), F.least(F.col("length"), F.lit(most)).cast("int")).alias("part"))
    return Y.hexdump(part, "path", "part")


def od(files: DataFrame) -> DataFrame:
    """Hex rows of each file, each with the chunk that it begins in."""
    rows = Y.hexdump(files.select("path", "content"), "path", "content")
    heads = walk.walk(files).select("path", F.col("offset").alias("_at"), "chunk_id")
    from tessera.operators import ordered

    out = ordered.asof(rows.withColumn("offset", F.col("offset").cast("bigint")), heads, ["path"], "offset", "_at", "chunk_id")
    return out.select("path", "offset", "hex", "ascii", F.col("asof_value").alias("chunk_id"))


def probe(files: DataFrame, offset: int, kind: str, big_endian: bool = False) -> DataFrame:
    """A typed value at an offset, in both byte orders."""
    return files.select("path", V.decode_value(F.col("content"), kind, offset, big_endian).alias("value"), V.decode_both(F.col("content"), kind, offset).alias("both"))


def locate(files: DataFrame, mode: str = "normal") -> DataFrame:
    """Regions of audio in each file."""
    return locating.located(files.select("path", "content"), "path", "content", mode)


def carve(files: DataFrame, regions: DataFrame | None = None, offset: int = 0, length: int | None = None, chunk: str | None = None) -> DataFrame:
    """Regions, a chunk's payload, or a range, cut out of each file."""
    if regions is not None:
        return samples_of.carve_regions(files, regions)
    if chunk is not None:
        return samples_of.carve_regions(files, C.resolve_address(walk.walk(files), chunk).select("path", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop")))
    return samples_of.carve(files, F.lit(offset), F.lit(length) if length is not None else F.octet_length("content") - offset)


def explore(files: DataFrame, offset: int, length: int) -> DataFrame:
    """A walk of a region of each file."""
    return locating.explored(files, F.lit(offset), F.lit(length))


def extract(files: DataFrame) -> DataFrame:
    """Samples of banks and modules as WAV files."""
    rows = samples_of.samples(files)
    return rows.select("path", "ordinal", "name", "rate", codecs.wav_of(F.col("pcm"), 44_100).alias("wav"))


def convert(files: DataFrame, codec: str = "wav", rate: int = 44_100, channels: int = 1) -> DataFrame:
    """Each file's samples decoded, in a WAV file; null where they can't be."""
    return files.select("path", codecs.wav_of(codecs.decoded(F.col("content"), codec), rate, channels).alias("wav"))


def wrap(files: DataFrame, rate: int, channels: int = 1, width: int = 2, big_endian: bool = False, is_float: bool = False) -> DataFrame:
    """Raw samples in a WAV file."""
    return files.select("path", codecs.wrapped(F.col("content"), rate, channels, width, big_endian, is_float).alias("wav"))


def cover(files: DataFrame) -> DataFrame:
    return samples_of.covers(files)


def scan(files: DataFrame, has: list[str] | None = None) -> DataFrame:
    """Metadata of each file, only of those that hold a chunk if some are named."""
    rows = indexing.metadata(files)
    if not has:
        return rows
    wanted = F.array(*[F.lit(h.strip().upper()) for h in has])
    return rows.where(F.arrays_overlap(F.split(F.upper("chunks"), ","), wanted))


def validate(files: DataFrame) -> DataFrame:
    return mending.validated(files)


def repair(files: DataFrame) -> DataFrame:
    """Each file put right, and how many violations were."""
    return files.select("path", "content").join(mending.analysed(files).where("repairable").groupBy("path").agg(F.count("*").alias("repaired")), "path").withColumn("content", mending.repaired(F.col("content")))


def audit(files: DataFrame) -> DataFrame:
    """Structure, oddities, integrity and provenance of each file, a row a statement, with its section."""
    rows = walk.walk(files)
    structure = mending.analysed(files).select("path", F.lit("structure").alias("section"), F.concat_ws(" ", "kind", "field").alias("statement"), F.col("offset"))
    odd = anomalies.scan(files).select("path", F.lit("hidden").alias("section"), F.concat_ws(": ", "rule", "message").alias("statement"), "offset")
    written = locating.provenance(rows).select("path", F.lit("provenance").alias("section"), F.concat_ws(" by ", "tool", "basis").alias("statement"), F.lit(None).cast("bigint").alias("offset"))
    bits = integrity(files).select("path", F.lit("integrity").alias("section"), F.concat(F.lit("effective bits "), "effective_bits").alias("statement"), F.lit(None).cast("bigint").alias("offset"))
    return structure.unionByName(odd).unionByName(written).unionByName(bits)


def integrity(files: DataFrame) -> DataFrame:
    """Bits that a WAV's samples have and use; eight or more unused ones of a thousand samples or more are told."""
    import numpy as np

    from tessera.sources import audio

    def made(data: bytes):
        bits = next((f.get("bits_per_sample") for tag, _, _, f, _ in audio.wav(data) if tag == "fmt "), None) if data[:4] == b"RIFF" else None
        for tag, at, size, *_ in audio.wav(data) if bits in (16, 24, 32) else ():
            if tag == "data":
                x = codecs.pcm(data[at + 8 : at + 8 + size], bits // 8)
                used = int(np.bitwise_or.reduce(x)) & (1 << bits) - 1 if len(x) else 0
                empty = (used & -used).bit_length() - 1 if used else bits
                yield bits, bits - empty, len(x) >= 1024 and empty >= 8

    return Y.each_value(files, ["path"], ["content"], "bits int, effective_bits int, padded boolean", made)


def write(files: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """Texts set in each file, or removed."""
    return files.select("path", mending.write_fields(F.col("content"), changes).alias("content"))


def features(files: DataFrame, rate: int = 22_050) -> DataFrame:
    """Numbers that describe each file's samples."""
    pcm = files.select("path", codecs.decoded(F.col("content"), "wav").alias("pcm")).where("pcm is not null")
    return signals.features_table(pcm, "path", "pcm", rate)


def detect(files: DataFrame, rate: int = 22_050) -> DataFrame:
    """Key and tempo of each file: the key from its pitch classes, the tempo vetted by that in its name."""
    pcm = files.select("path", codecs.decoded(F.col("content"), "wav").alias("pcm")).where("pcm is not null")
    keys = search.estimate_key(signals.chromas(pcm, "path", "pcm", rate), "path")
    tempi = Y.each_value(pcm, ["path"], ["pcm"], "detected double", lambda x: iter([(signals.tempo(Y.numbers_of(x, "i16"), rate),)]))
    best = music.improve_bpm(F.col("detected"), music.bpm_from_filename(F.col("path")).cast("double"))
    return keys.join(tempi.select("path", best.alias("_b")).select("path", F.col("_b.bpm").alias("bpm"), F.col("_b.origin").alias("origin")), "path")


def formats() -> list[dict[str, object]]:
    """What can be done with each format."""
    return [{"format": k, "inspect": True, "extract": k in samples_of.EXTRACTORS, "write": k in ("wav", "aiff", "aifc"), "repair": k in ("wav", "aiff", "aifc", "8svx", "flac", "mp4", "sf2", "rmid"), "preset": k in _FORMATS} for k in sorted(walk.PARSERS)]


# Catalogue


def index(spark: SparkSession, root: str, before: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    return indexing.index(spark, root, before)


def query(rows: DataFrame, bpm: str | None = None, duration: str | None = None, tags: DataFrame | None = None, wanted_tags: list[str] | None = None, text: str | None = None, limit: object = None, **equals: str | None) -> DataFrame:
    """Rows that fit all of it, in order of their paths."""
    if wanted_tags and tags is not None:
        rows = C.with_tags(rows, tags, wanted_tags)
    if text:
        rows = X.match_text(rows, text, [c for c in ("title", "artist", "album", "genre", "comment", "preset_name", "path") if c in rows.columns], stemmed=True)
    return C.select_rows(rows, C.build_filter(bpm, duration, **equals), limit=C.row_limit(limit))


def similar(features_: DataFrame, target_id: int, n: int = 10) -> DataFrame:
    return search.find_similar(features_, target_id).orderBy(F.desc("similarity"), "vec_id").limit(n)


def search_samples(rows: DataFrame, limit: int = 50, **asked) -> DataFrame:
    """A page of rows with the total that fits."""
    return C.page(rows.where(C.build_filter(**asked)), ["path"], C.row_limit(limit))


def get_sample(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("path") == path)


def locate_sample(rows: DataFrame, name: str, limit: int = 50) -> DataFrame:
    return C.page(C.locate(rows, name), ["path"], C.row_limit(limit))


def list_libraries(registry: DataFrame) -> DataFrame:
    return C.listed(registry)


def list_tags(tags: DataFrame, prefix: str = "") -> DataFrame:
    pattern = (C.escape_like(prefix) + "%").replace("'", "''")
    return C.histogram(tags.where(F.expr(f"tag ilike '{pattern}' escape '!'")), "tag").orderBy(F.desc("n"), "tag")


def list_keys(rows: DataFrame) -> DataFrame:
    return C.histogram(rows, "key").orderBy(F.desc("n"), "key")


def list_formats(rows: DataFrame) -> DataFrame:
    return C.histogram(rows, "format").orderBy(F.desc("n"), "format")


def index_stats(rows: DataFrame, tags: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("samples"), F.count_distinct("format").alias("formats"), F.max("last_seen_at").alias("last_seen_at")).join(F.broadcast(tags.agg(F.count_distinct("tag").alias("tags"))))


def find_compatible(rows: DataFrame, key: str | None, bpm: float | None, **asked) -> DataFrame:
    return search.find_compatible(rows, key, bpm, **asked)


def find_similar(features_: DataFrame, target_id: int, n: int = 10) -> DataFrame:
    return similar(features_, target_id, n)


def analyze_sample(files: DataFrame, path: str) -> DataFrame:
    return info(files.where(F.col("path") == path))


def detect_bpm_key(files: DataFrame, path: str) -> DataFrame:
    return detect(files.where(F.col("path") == path))


def reindex(spark: SparkSession, root: str, before: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    return indexing.index(spark, root, before)


def reindex_features(files: DataFrame, known: DataFrame, current: int) -> DataFrame:
    """Features of files that have none of the current version."""
    return features(files.join(known.where(F.col("version") == current).select("path"), "path", "left_anti")).withColumn("version", F.lit(current))


def register_library(registry: DataFrame, root: str, label: str, seen: Column | None = None) -> DataFrame:
    return C.register(registry, root, label, seen if seen is not None else F.current_timestamp())


def forget_library(registry: DataFrame, label_or_root: str) -> DataFrame:
    return C.forget(registry, label_or_root)


def discover_libraries(files: DataFrame, registry: DataFrame, least: int = 20) -> DataFrame:
    return C.discover(files, registry, least)


def tag_sample(tags: DataFrame, path: str, add: list[str] | None = None, remove: list[str] | None = None, replace: bool = False) -> DataFrame:
    """Tags with some of a path added, put in the place of all of them, or removed."""
    spark = tags.sparkSession
    if add:
        tags = C.set_tags(tags, spark.createDataFrame([(path, t) for t in add], "path string, tag string"), replace)
    return C.remove_tags(tags, spark.createDataFrame([(path, t) for t in remove], "path string, tag string")) if remove else tags


def set_sample_description(descriptions: DataFrame, path: str, description: str | None) -> DataFrame:
    return C.set_description(descriptions, descriptions.sparkSession.createDataFrame([(path, description)], "path string, description string"))


# Renderings

RENDERINGS: dict[str, Callable[[DataFrame], str]] = {
    "json": lambda rows: "[" + ", ".join(rows.toJSON().toLocalIterator()) + "]",
    "csv": lambda rows: "\n".join([",".join(rows.columns), *(r[0] for r in rows.select(F.to_csv(F.struct(*rows.columns))).toLocalIterator())]) + "\n",
    "table": lambda rows: "\n".join(": ".join((c, str(r[c]))) for r in rows.toLocalIterator() for c in rows.columns if r[c] is not None) + "\n",
}


def register_format(name: str, render: Callable[[DataFrame], str]) -> None:
    """A rendering under a name of its own."""
    RENDERINGS[name] = render


def output(rows: DataFrame, fmt: str, path: str | None = None) -> str | None:
    """Rows as text in a named rendering; with a path they are written there by Spark (json, csv), whatever their number."""
    if path is None:
        return RENDERINGS[fmt](rows)
    rows.write.mode("errorifexists").option("header", "true").format(fmt).save(path)
    return None


VERBS = ["audit", "carve", "census", "chunks", "classify", "convert", "cover", "detect", "dump", "explore", "extract", "features", "formats", "index", "info", "inspect", "locate", "od", "probe", "query", "repair", "scan", "shape", "similar", "survey", "validate", "wrap", "write"]
TOOLS = ["search_samples", "get_sample", "locate_sample", "list_libraries", "list_tags", "list_keys", "list_formats", "index_stats", "find_compatible", "find_similar", "analyze_sample", "detect_bpm_key", "reindex", "reindex_features", "register_library", "forget_library", "discover_libraries", "tag_sample", "set_sample_description"]
__all__ = [*VERBS, *TOOLS, "output", "register_format", "integrity"]

"""Containers as tables: file bytes in, a row for each chunk out, with the chunk's decoded fields.

Parsers are plain generators over bytes, run in Arrow batches where the files are read. Damaged input never fails the job: what could be
read stands, and the trouble is told in a row of kind ``warning``. Sizes that a file claims are never believed beyond its end.
"""

from __future__ import annotations

import functools
import inspect
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sniffing import sniff
from tessera.sources import audio, containers, formats
from tessera.sources.chunks import Chunk, number, printable

SCHEMA = "path string, format string, ordinal int, chunk_id string, offset bigint, size bigint, fields map<string,string>, warning string"


def generic(data: bytes) -> Iterator[Chunk]:
    """A grid of [tag][size] from offset 8 or 12, in either byte order, that tiles the file to within three bytes."""
    for order in ("little", "big"):
        for start in (8, 12):
            rows, at = [], start
            while at + 8 <= len(data):
                tag, size = data[at : at + 4], number(data, at + 4, 4, order)
                if not size or not all(32 <= b < 127 for b in tag) or at + 8 + size > len(data) + 1:
                    break
                rows.append((printable(tag), at, size, {"order": order}, None))
                at += 8 + size
            if len(rows) >= 2 and len(data) - at <= 3:
                yield from rows
                return


#: Parsers by format id; register() adds to them.
PARSERS: dict[str, Callable[..., Iterator[Chunk]]] = audio.PARSERS | formats.PARSERS | containers.PARSERS


def register(kind: str, parser: Callable[[bytes], Iterator[Chunk]]) -> None:
    """Adds a parser for a format id, or replaces one."""
    PARSERS[kind] = parser


def wrapped(data: bytes) -> Iterator[Chunk]:
    """A container behind an ID3 tag: the tag's rows, then the container's."""
    at = 0
    for row in audio.id3v2(data):
        yield row
        at = row[2] if row[0] == "ID3" else at
    _, rows = walk_bytes(data[at:])
    yield from ((tag, at + offset, size, fields, warning) for tag, offset, size, fields, warning in rows)


PARSERS["id3-wrapped"] = wrapped


@functools.cache
def _takes_name(parser: Callable[..., Iterator[Chunk]]) -> bool:
    return "name" in inspect.signature(parser).parameters


def walk_bytes(data: bytes, forced: str | None = None, name: str = "") -> tuple[str | None, list[Chunk]]:
    kind = forced or sniff(data, name)
    parser = PARSERS.get(kind, generic)
    rows: list[Chunk] = []
    try:
        rows.extend(parser(data, name) if _takes_name(parser) else parser(data))
    except (struct.error, IndexError, KeyError, ValueError, OverflowError, TypeError, RecursionError) as error:
        rows.append(("warning", len(data), 0, {}, f"stopped: {error}"))
    return kind, rows


def walk(files: DataFrame, path: str = "path", content: str = "content", forced: str | None = None) -> DataFrame:
    """A row a chunk of every file. Null contents count as empty; a file without chunks has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("ordinal", pa.int32()), ("chunk_id", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("warning", pa.string())])
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                kind, chunks = walk_bytes(value.as_py() or b"", forced, name.as_py() or "")
                path = name.as_py()
                for i, (tag, at, size, decoded, warning) in enumerate(chunks):
                    rows.append((path, kind, i, tag, at, size, [(k, str(v)) for k, v in decoded.items() if v is not None], warning))
                if len(rows) > 100_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def read_files(spark, path: str, glob: str = "*", most_bytes: int = 256 << 20) -> DataFrame:
    """Files under a path as rows. Of larger ones the content is null, so that they are rows too; names that systems leave behind are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.where(~junk(F.regexp_extract("path", r"([^/]*)$", 1)))
    small = files.where(F.col("length") <= most_bytes)
    return small.unionByName(files.where(F.col("length") > most_bytes).drop("content").withColumn("content", F.lit(None).cast("binary")))


def junk(name: F.Column) -> F.Column:
    """Names that systems leave behind."""
    return F.lower(name).startswith("._") | F.lower(name).isin(".ds_store", "thumbs.db", "desktop.ini")


def flatten_fields(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "chunk_id", "ordinal", F.explode("fields").alias("field", "value"))


def survey(chunks: DataFrame) -> DataFrame:
    """Files that hold each chunk id (each file once), and the first of them."""
    once = chunks.groupBy("path", "chunk_id").agg(F.count("*").alias("_n"))
    return once.groupBy("chunk_id").agg(F.count("*").cast("bigint").alias("files"), F.min("path").alias("example"))


def census(chunks: DataFrame) -> DataFrame:
    """Occurrences and bytes of each chunk id, and warnings on it."""
    return chunks.groupBy("format", "chunk_id").agg(F.count("*").cast("bigint").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"), F.count("warning").cast("bigint").alias("warnings"))


def shapes(chunks: DataFrame) -> DataFrame:
    """How many files have each set of chunk ids."""
    each = chunks.groupBy("path", "format").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("ids"))
    return each.groupBy("format", "ids").agg(F.count("*").cast("bigint").alias("files"))


#: Examples that a census keeps of each odd thing; it counts all of them.
EXAMPLES = 25


def census_of(chunks: DataFrame, top: int = 40) -> DataFrame:
    """``kind``, ``value``, ``n``, ``first``, ``examples``: the commonest of each kind of thing that a corpus' chunks say, an occurrence each.

    Kinds are chunk ids, format tags, list types, fact sizes, bext versions, formats, and the flags (a fact that isn't four bytes, an empty data chunk, an odd size, a warning). Partial
    counts are made before the shuffle; of examples no more than EXAMPLES of a value are kept, in order of their paths.
    """
    from pyspark.sql import Window

    pair = lambda kind, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    name, field = F.col("chunk_id"), F.col("fields")
    told = [
        pair("chunk", name), pair("format_tag", field["format_tag"], (name == "fmt ") & field["format_tag"].isNotNull()), pair("list_type", field["list_type"], field["list_type"].isNotNull()),
        pair("fact_size", F.col("size"), name == "fact"), pair("bext_version", field["version"], (name == "bext") & field["version"].isNotNull()), pair("container", F.col("format"), F.col("ordinal") == 0),
        pair("flag", F.lit("fact_not_4"), (name == "fact") & (F.col("size") != 4)), pair("flag", F.lit("empty_data"), (name == "data") & (F.col("size") == 0)), pair("flag", F.lit("odd_size"), F.col("size") % 2 == 1), pair("flag", F.lit("warning"), F.col("warning").isNotNull()),
    ]
    rows = chunks.select("path", F.explode(F.array_compact(F.array(*told))).alias("_t")).select("path", "_t.kind", "_t.value")
    each = rows.groupBy("kind", "value", "path").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("kind", "value").orderBy("path")
    shown = each.withColumn("_place", F.row_number().over(w)).where((F.col("kind") == "flag") & (F.col("_place") <= EXAMPLES)).groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("examples"))
    sums = each.groupBy("kind", "value").agg(F.sum("_n").cast("bigint").alias("n"), F.min("path").alias("first"))
    ranked = sums.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top).drop("_r")
    return ranked.join(shown, ["kind", "value"], "left")


def cheap_shapes(files: DataFrame) -> DataFrame:
    """How many RIFF and IFF files have each set of chunk ids; no fields are read."""
    from tessera.functions.bytes import each_value
    from tessera.sources.chunks import iff

    def made(data: bytes) -> Iterator[tuple]:
        order = {b"RIFF": "little", b"FORM": "big"}.get(data[:4])
        if order:
            yield printable(data[8:12]), ",".join(sorted({tag for tag, *_ in iff(data, order)}))

    each = each_value(files, ["path"], ["content"], "form string, ids string", made)
    return each.groupBy("form", "ids").agg(F.count("*").cast("bigint").alias("files"))

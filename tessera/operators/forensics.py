"""Integrity and anomaly rules, constraint checks and signal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the gravest, and chunk ids that a file may hold once.
SEVERITIES = ["alert", "warn", "notice", "info"]
UNIQUE_CHUNKS = ["fmt ", "data", "fact", "smpl", "inst", "acid", "bext"]


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    hits = chunks.where(F.col("chunk_id").isin(UNIQUE_CHUNKS)).groupBy("path", "chunk_id").agg(F.count("*").alias("n"), F.max("offset").alias("offset")).where("n > 1")
    return hits.select("path", F.lit("duplicate_chunk").alias("rule"), F.lit("warn").alias("severity"), "offset")


def defects(chunks: DataFrame) -> DataFrame:
    return chunks.where("warning is not null").select("path", F.lit("structure").alias("rule"), F.lit("warn").alias("severity"), "offset")


def trailing_data(files: DataFrame, chunks: DataFrame) -> DataFrame:
    ends = chunks.groupBy("path").agg(F.max(F.col("offset") + 8 + F.col("size") + F.col("size") % 2).alias("stop"))
    return files.join(ends, "path").where((F.col("stop") > 0) & (F.col("stop") < F.octet_length("content"))).select("path", F.lit("trailing_data").alias("rule"), F.lit("notice").alias("severity"), F.col("stop").alias("offset"))


def nonzero_pad(files: DataFrame, chunks: DataFrame) -> DataFrame:
    odd = chunks.where("size % 2 = 1").select("path", (F.col("offset") + 8 + F.col("size")).alias("offset"))
    byte = F.hex(F.substring("content", (F.col("offset") + 1).cast("int"), F.lit(1)))
    return files.join(odd, "path").where((byte != "") & (byte != "00")).select("path", F.lit("nonzero_pad").alias("rule"), F.lit("warn").alias("severity"), "offset")


def ordered_findings(*parts: DataFrame) -> DataFrame:
    """All rules' findings, the gravest first, then by offset."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(rank, F.coalesce("offset", F.lit(-1)), "rule")))


def size_violations(files: DataFrame, little_endian_size: Column) -> DataFrame:
    """Files whose declared size isn't theirs, with the size that would be."""
    computed = F.octet_length("content") - 8
    return files.select("path", little_endian_size.alias("stored"), computed.cast("bigint").alias("computed")).where("stored <> computed")


def repaired_size(content: Column) -> Column:
    """The content with a right size field; the rest is untouched."""
    n = F.octet_length(content) - 8
    parts = [F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]
    return F.concat(F.substring(content, 1, 4), F.unhex(F.concat(*parts)), F.substring(content, F.lit(9), F.octet_length(content)))


def effective_bits(rows: DataFrame, keys: list[str], sample: str, width: int) -> DataFrame:
    """Width less the zero bits that all samples end with; null if all are zero."""
    ored = rows.groupBy(*keys).agg(F.bit_or(sample).alias("_or"))
    low = F.col("_or").bitwiseAND(-F.col("_or"))
    return ored.select(*keys, F.when(F.col("_or") != 0, width - F.round(F.log2(low)).cast("int")).alias("bits"))


def channel_relation(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Correlation of two channels and the level of their difference: dual mono, near mono or stereo."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    side = F.sum((l - r) * (l - r)) / F.nullif(F.sum((l + r) * (l + r)), F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.round(F.coalesce(F.corr(left, right), F.lit(0.0)), 6).alias("correlation"), side.alias("_side"), F.max(F.abs(l - r)).alias("_most"))
    level = F.when(F.col("_side") > 0, F.round(10 * F.log10("_side"), 4))
    kind = F.when(F.col("_most") == 0, "dual_mono").when((F.col("correlation") >= 0.9995) & (level <= -60), "near_mono").otherwise("stereo")
    return out.select(*keys, "correlation", level.alias("side_db"), kind.alias("kind"))

"""Integrity and anomaly queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytes as Y
from tessera.operators import forensics as X
from tessera.sources import bindings as B
from tessera.sources import walk as K

QUERIES, ORACLES = {}, {}


def query(sql: str, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


def _marred(spark, d):
    """Every third file has bytes after its end, every third of the odd ones a pad byte that isn't zero."""
    files = B.riff_files(spark, d)
    k = F.pmod(F.col("n"), F.lit(3))
    tail = F.concat("content", F.unhex(F.lit("00112233445566")))
    pad = F.concat(F.substring("content", F.lit(1), F.octet_length("content") - 1), F.unhex(F.lit("7F")))
    return files.withColumn("content", F.when(k == 0, tail).when((k == 1) & (F.col("n") % 2 == 1), pad).otherwise(F.col("content")))


_END = "(44 + n + n % 2 + CASE WHEN has_fact THEN 12 ELSE 0 END)"


@query(
    f"SELECT path, rule, severity, \"offset\"::BIGINT AS \"offset\", row_number() OVER (PARTITION BY path ORDER BY CASE severity WHEN 'alert' THEN 1 WHEN 'warn' THEN 2 WHEN 'notice' THEN 3 ELSE 4 END, \"offset\", rule)::INT AS place FROM ("
    f"SELECT path, 'structure' AS rule, 'warn' AS severity, 0 AS \"offset\" FROM riff WHERE n % 3 = 0 UNION ALL SELECT path, 'trailing_data', 'notice', {_END} FROM riff WHERE n % 3 = 0 "
    f"UNION ALL SELECT path, 'nonzero_pad', 'warn', {_END} - 1 FROM riff WHERE n % 3 = 1 AND n % 2 = 1)",
    B.RIFF,
)
def anomaly_findings(spark, d):
    files = _marred(spark, d)
    chunks = K.walk(files)
    body = chunks.where("chunk_id <> 'RIFF'")
    return X.ordered_findings(X.defects(chunks), X.trailing_data(files, body.where("chunk_id in ('fmt ', 'fact', 'data')")), X.nonzero_pad(files, body.where("chunk_id in ('fmt ', 'fact', 'data')")), X.duplicate_chunks(body))


@query(f"SELECT path, ({_END} - 8)::BIGINT AS stored, ({_END} - 1)::BIGINT AS computed FROM riff WHERE n % 3 = 0", B.RIFF)
def size_violations(spark, d):
    return X.size_violations(_marred(spark, d), Y.read_typed(F.col("content"), 4, "u32"))


@query("SELECT count(*)::BIGINT AS files, 0::BIGINT AS violations FROM riff", B.RIFF)
def size_repaired(spark, d):
    fixed = _marred(spark, d).withColumn("content", X.repaired_size(F.col("content")))
    wrong = (Y.read_typed(F.col("content"), 4, "u32") != F.octet_length("content") - 8).cast("bigint")
    return fixed.agg(F.count("*").cast("bigint").alias("files"), F.sum(wrong).cast("bigint").alias("violations"))


@query("SELECT l_suppkey, 16 - CASE bit_or(l_quantity::BIGINT * 4) & -bit_or(l_quantity::BIGINT * 4) WHEN 4 THEN 2 WHEN 8 THEN 3 WHEN 16 THEN 4 WHEN 32 THEN 5 END AS bits FROM lineitem GROUP BY 1")
def effective_bits(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity").cast("bigint") * 4).alias("sample"))
    return X.effective_bits(rows, ["l_suppkey"], "sample", 16)


@query("SELECT l_suppkey, round(corr(l_quantity, r), 6) AS correlation, round(10 * log10(sum((l_quantity - r) * (l_quantity - r)) / sum((l_quantity + r) * (l_quantity + r))), 4) AS side_db, 'stereo' AS kind FROM (SELECT l_suppkey, l_quantity, l_quantity + l_linenumber AS r FROM lineitem) GROUP BY 1")
def channel_relations(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("l"), (F.col("l_quantity") + F.col("l_linenumber")).alias("r"))
    return X.channel_relation(rows, ["l_suppkey"], "l", "r")


@query("SELECT k AS id, CASE WHEN k % 4 = 0 THEN '' ELSE strftime(make_timestamp((k::BIGINT * 100003 - 2082844800) * 1000000), '%Y-%m-%dT%H:%M:%S') END AS date FROM (SELECT p_partkey AS k FROM part)")
def mac_dates(spark, d):
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select(k.alias("id"), Y.mac_date(F.when(k % 4 == 0, F.lit(0)).otherwise(k * 100003)).alias("date"))


@query("SELECT p_partkey AS id, ((p_partkey >> 2) & 7) - 3 AS value FROM part")
def bitfields(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), Y.bitfield(F.col("p_partkey"), 2, 3, 3).alias("value"))

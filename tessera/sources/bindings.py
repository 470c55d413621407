"""The catalogue's tables over the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key names that samples cycle through; two more slots are null.
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B", "Cm", "C#m", "Dm", "D#m", "Em", "Fm", "F#m", "Gm", "G#m", "Am", "A#m", "Bm"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of five libraries. Paths repeat now and then, as copies of a file in a library do."""
    t = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("/lib"), F.col("l_suppkey") % 5, F.lit("/pack"), F.col("l_partkey") % 20, F.lit("/s"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey", F.lit(".wav"))
    slot = ((F.col("l_partkey") + F.col("l_linenumber")) % 26).cast("int")
    return t.select(
        path.alias("path"),
        (F.col("l_suppkey") % 5).alias("library"),
        F.when(F.col("l_orderkey") % 7 != 0, 60 + F.col("l_partkey") % 140).cast("double").alias("bpm"),
        F.get(F.array(*map(F.lit, KEYS)), slot).alias("key"),
        (F.col("l_quantity") / 10).alias("duration"),
        F.when(F.col("l_linenumber") % 3 == 0, 4 * F.col("l_linenumber")).cast("bigint").alias("acid_beats"),
        F.when(F.col("l_returnflag") == "A", "wav").when(F.col("l_returnflag") == "N", "flac").when(F.col("l_returnflag") == "R", "mp3").alias("format"),
        F.col("l_orderkey").alias("size"),
    )


SAMPLES = (
    "samples AS (SELECT '/lib' || (l_suppkey % 5) || '/pack' || (l_partkey % 20) || '/s' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.wav' AS path, "
    "l_suppkey % 5 AS library, CASE WHEN l_orderkey % 7 <> 0 THEN (60 + l_partkey % 140)::DOUBLE END AS bpm, "
    f"list_extract({KEYS}, ((l_partkey + l_linenumber) % 26 + 1)::INT) AS key, l_quantity / 10 AS duration, "
    "CASE WHEN l_linenumber % 3 = 0 THEN (4 * l_linenumber)::BIGINT END AS acid_beats, "
    "CASE l_returnflag WHEN 'A' THEN 'wav' WHEN 'N' THEN 'flac' WHEN 'R' THEN 'mp3' END AS format, l_orderkey AS size FROM lineitem)"
)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return t.select(F.concat(F.lit("/part/"), "p_partkey").alias("path"), F.explode(words).alias("tag")).where("tag <> ''")


TAGS = "tags AS (SELECT * FROM (SELECT '/part/' || p_partkey AS path, unnest(string_split(concat_ws(' ', p_name, p_type, p_brand), ' ')) AS tag FROM part) WHERE tag <> '')"


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, some of them inside others: each library and each of its packs."""
    s = samples(spark, sf_dir)
    root = F.regexp_extract("path", r"^(/lib\d+)", 1)
    pack = F.regexp_extract("path", r"^(/lib\d+/pack\d+)", 1)
    return s.select(F.explode(F.array(root, pack)).alias("root")).distinct().select("root", F.regexp_replace(F.substring("root", 2, 100), "/", "_").alias("label"))


LIBRARIES = "libraries AS (SELECT DISTINCT root, replace(substr(root, 2), '/', '_') AS label FROM (SELECT unnest([regexp_extract(path, '^(/lib\\d+)', 1), regexp_extract(path, '^(/lib\\d+/pack\\d+)', 1)]) AS root FROM samples))"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors with their version: one in ten is stale."""
    t = table(spark, sf_dir, "embeddings")
    duration = (F.col("vec_id") % 40) / 10.0
    return t.select("vec_id", "embedding", "label", F.when(F.col("vec_id") % 10 != 9, 3).otherwise(2).alias("version"), duration.alias("duration"), F.when(F.col("vec_id") % 8 == 0, 8).otherwise(0).cast("bigint").alias("acid_beats"))


FEATURES = "features AS (SELECT vec_id, embedding, label, CASE WHEN vec_id % 10 <> 9 THEN 3 ELSE 2 END AS version, (vec_id % 40) / 10.0::DOUBLE AS duration, CASE WHEN vec_id % 8 = 0 THEN 8 ELSE 0 END::BIGINT AS acid_beats FROM embeddings)"


def le32(x: F.Column) -> F.Column:
    """Four little-endian bytes of an integer."""
    parts = [F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]
    return F.unhex(F.concat(*parts))


def le32_sql(x: str) -> str:
    return f"unhex(printf('%02X%02X%02X%02X', {x} & 255, ({x} >> 8) & 255, ({x} >> 16) & 255, ({x} >> 24) & 255))"


def riff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files built from conversations' texts: a format chunk, a fact chunk now and then, and the text as data."""
    t = table(spark, sf_dir, "conversations").where("text is not null")
    payload = F.col("text").cast("binary")
    n = F.octet_length("text").cast("int")
    pad = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    even = (F.col("conv_id") + F.col("turn")) % 2 == 0
    fact = F.when(even, F.concat(F.encode(F.lit("fact"), "UTF-8"), le32(F.lit(4)), le32(n))).otherwise(F.unhex(F.lit("")))
    size = 36 + n + n % 2 + F.when(even, 12).otherwise(0)
    content = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), le32(size.cast("int")), F.encode(F.lit("WAVEfmt "), "UTF-8"), le32(F.lit(16)), F.unhex(F.lit("0100010044AC00008858010002001000")), fact, F.encode(F.lit("data"), "UTF-8"), le32(n), payload, pad)
    return t.select(F.concat(F.lit("/conv/"), "conv_id", F.lit("/"), "turn", F.lit(".wav")).alias("path"), content.alias("content"), n.alias("n"), even.alias("has_fact"))


RIFF = (
    "riff AS (SELECT '/conv/' || conv_id || '/' || turn || '.wav' AS path, strlen(text)::INT AS n, (conv_id + turn) % 2 = 0 AS has_fact FROM conversations WHERE text IS NOT NULL)"
)

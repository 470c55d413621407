"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir`` of the session, or what its context was told to checkpoint to.

    Only where neither is set and all runs on this machine (tests, a laptop) is a temporary folder made; it goes when Python ends.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    told = context._jsc.sc().getCheckpointDir()
    if told.isDefined():
        return told.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN_DIRS:
        _OWN_DIRS[context.applicationId] = own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written, once no DataFrame that rests on them is needed; how many there were."""
    jvm, done = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def materialise(df: DataFrame, label: str, passing: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Lost executors cost nothing afterwards, and unlike a checkpointed RDD the table keeps exact
    sizes for the join planner, column pruning and compression. What is shuffled stays on disk until
    the driver happens to collect garbage; where it is ``passing`` it goes as soon as the table is written.
    """
    path = scratch_path(df.sparkSession, label)
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    if passing:
        conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        if passing:
            conf.unset(name) if before is None else conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_lookup(left: DataFrame, right: DataFrame, key: str | list[str], salt_from: Column, salts: int = 16, grows: bool = True) -> DataFrame:
    """Left join on ``key`` where one key of ``left`` may hold a large share of the rows.

    ``right`` has at most one row a key. The rows of a key of ``left`` are dealt over ``salts`` partitions, and ``right`` is repeated that often. Where
    ``right`` ``grows`` with the input it is always shuffled: the planner isn't left to broadcast it.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    return salted.join(spread.hint("shuffle_merge") if grows else spread, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")


def measured_lookup(left: DataFrame, right: DataFrame, key: str, salt_from: Column, share: int = 2000) -> DataFrame:
    """Inner join on ``key`` with wide rows of ``right``, at most one a key: only keys of more than ``share`` rows of ``left`` are salted, by their counts.

    ``left`` is read twice, so it should be a written table. There are at most as many such keys as ``left`` has rows by ``share``.
    """
    common = left.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") > share).select(key, F.ceil(F.col("_c") / share).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    spread = right.join(common, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    salted = left.join(common, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_from), one).cast("int")).drop("_salts")
    return salted.join(spread.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


def input_bytes(df: DataFrame) -> int:
    """Bytes that the planner expects ``df`` to have, 0 where it doesn't know; used only to choose numbers of partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def parallelism(df: DataFrame, bytes_each: int = 16 << 20, least: int = 12, most: int = 100_000) -> int:
    size = input_bytes(df)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(most, max(least, size // bytes_each))) if size else usual

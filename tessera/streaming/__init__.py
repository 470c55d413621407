"""Incremental counterparts on Structured Streaming: sliding counts, sessions, and snapshot upserts of a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import path_for


def drained(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there now, and return its rows: each micro-batch replaces (complete) or follows (append) the last."""
    spark, out, state = stream.sparkSession, path_for(stream.sparkSession, label), path_for(stream.sparkSession, f"{label}-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name[1] if _is_file(spark, path) else "*.parquet").parquet(name[0] if _is_file(spark, path) else path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def sliding_counts(rows: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").cast("bigint").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").cast("bigint").alias("n"))


def upserted(stream: DataFrame, key: str, order: str, folder: str | None = None) -> DataFrame:
    """The last row of each key, kept as a snapshot that each micro-batch is merged into.

    Batch n reads the snapshot of the batch before it, whose number the stream's checkpoint knows: a stream that is started again on the same ``folder``
    goes on from there, and a batch that is run again writes the same snapshot.
    """
    spark, root = stream.sparkSession, folder or path_for(stream.sparkSession, "snapshot")
    snapshot = lambda n: f"{root}/snapshots/batch={n}"

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch if n == 0 else batch.unionByName(spark.read.schema(stream.schema).parquet(snapshot(n - 1)))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(snapshot(n))

    query = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    last = _latest(spark, f"{root}/snapshots")
    return spark.read.schema(stream.schema).parquet(snapshot(last)) if last is not None else spark.createDataFrame([], stream.schema)


def _latest(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that has a whole snapshot."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    done = [int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(folder) if system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max(done, default=None)

"""Streams drained over a folder give the batch answer."""

import datetime

from pyspark.sql import functions as F

from tessera import streaming as S


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=7 * i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = S.events(spark, str(tmp_path))
    got = S.drained(S.sliding_counts(stream), "complete", "t").agg(F.sum("n")).first()[0]
    assert got == 80  # each event is in two windows
    last = S.upserted(S.events(spark, str(tmp_path)).select("user_id", "event_id"), "user_id", "event_id")
    assert sorted(map(tuple, last.collect())) == [(0, 39), (1, 37), (2, 38)]


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    """A second run on the same folder reads only what is new, and keeps what the first one had."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(source)
    write([(1, 1), (2, 1)])
    stream = lambda: spark.readStream.schema("k long, v long").parquet(source)
    assert sorted(map(tuple, S.upserted(stream(), "k", "v", folder).collect())) == [(1, 1), (2, 1)]
    write([(2, 5), (3, 2)])
    assert sorted(map(tuple, S.upserted(stream(), "k", "v", folder).collect())) == [(1, 1), (2, 5), (3, 2)]

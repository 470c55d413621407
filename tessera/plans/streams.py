"""Streaming queries; their oracles are the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import streaming as S

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_type, w AS start_s, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([s // 3600 * 3600, s // 3600 * 3600 - 3600]) AS w FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)) GROUP BY 1, 2")
def stream_sliding(spark, d):
    out = S.drained(S.sliding_counts(S.events(spark, d)), "complete", "sliding")
    return out.select("event_type", F.unix_timestamp("window.start").alias("start_s"), "n", "total")


@query("SELECT user_id, (epoch_us(min(ts)) // 1000000)::BIGINT AS start_s, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def stream_sessions(spark, d):
    out = S.drained(S.sessions(S.events(spark, d)), "complete", "sessions")
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("start_s"), "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, d):
    return S.upserted(S.events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")

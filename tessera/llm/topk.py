"""Exact top-k by inner product with a KD-tree in each shard.

A shard's vectors are split at medians of the widest dimension, and each node keeps the tight box around its vectors.
The largest inner product that a box allows (the sum of each dimension's better corner) orders a best-first traversal, which
ends when no box left can beat the query's kth score. Queries go through the shards in waves: one shard first, then WAVE times as many as
before. The kth score of all that a query has met is its bound in the next wave, and prunes from the first box on.
A shard's tree is built once a wave that it is in, which is one, and blocks of queries are streamed to it.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._shards import finite, meet, shards_of

#: Vectors of a shard: so many, and as many at most; of a leaf.
SHARD, MOST, LEAF = 4096, 65_536, 128
#: How many times more shards each wave has than all before it.
WAVE = 7
_EXACT = float(1 << 53)


def scaled(vector: str, scale: int) -> F.Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


class Tree:
    """A KD-tree over rows of ``points`` (doubles that hold integers)."""

    def __init__(self, points: np.ndarray):
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._grow(points, np.arange(len(points)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        at = len(self.rows)
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and (high > low).any():
            order = np.argsort(part[:, int(np.argmax(high - low))], kind="stable")
            half = len(rows) // 2
            self.rows[at] = None
            self.children[at] = (self._grow(points, rows[order[:half]]), self._grow(points, rows[order[half:]]))
        return at


class Shard:
    """A shard's vectors (doubles that hold integers) with their tree."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points, self.tree = ids, points, Tree(points)
        self.largest = max(1, points.shape[1]) * max(1.0, np.abs(points).max(initial=0))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
        """Per query its k best of these points, ties to the smaller id: (query's index, id, score) arrays.

        ``bounds``: scores that a result must reach (-inf: none known).
        """
        tree, ids, points = self.tree, self.ids, self.points
        exact = self.largest * max(1.0, np.abs(queries).max(initial=0)) < _EXACT
        if not exact:  # beyond doubles' integers
            points = np.array([[int(x) for x in row] for row in points], dtype=object)
            queries = np.array([[int(x) for x in row] for row in queries], dtype=object)
        tops = np.maximum(queries, 0).astype(float) @ tree.high.T + np.minimum(queries, 0).astype(float) @ tree.low.T
        if not exact:
            tops += np.abs(tops) * 1e-9
        out_q, out_id, out_s = [], [], []
        for i, q in enumerate(queries):
            limit, got, got_ids = bounds[i], np.empty(0, float if exact else object), np.empty(0, np.int64)
            heap = [(-tops[i, 0], 0)]
            while heap:
                top, node = heappop(heap)
                if -top < limit:
                    break
                if tree.children[node] is not None:
                    for child in tree.children[node]:
                        if tops[i, child] >= limit:
                            heappush(heap, (-tops[i, child], child))
                    continue
                rows = tree.rows[node]
                rows = rows[ids[rows] != query_ids[i]]
                scores = points[rows] @ q
                good = scores >= limit
                got, got_ids = np.concatenate([got, scores[good]]), np.concatenate([got_ids, ids[rows[good]]])
                if len(got) > k:
                    order = np.lexsort((got_ids, -got)) if exact else sorted(range(len(got)), key=lambda n: (-got[n], got_ids[n]))
                    got, got_ids = got[order[:k]], got_ids[order[:k]]
                if len(got) == k:
                    limit = max(limit, float(min(got)) if exact else float(min(got)) - abs(float(min(got))) * 1e-9)
            out_q.append(np.full(len(got), i))
            out_id.append(got_ids)
            out_s.extend(got.tolist())
        return np.concatenate(out_q or [np.empty(0, int)]).astype(int), np.concatenate(out_id or [np.empty(0, np.int64)]), [int(x) for x in out_s]


def _search(k: int):
    def search(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        q, ids, scores = shard.best(query_ids, queries, bounds, k)
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (bigint): each query's k largest integer inner products.

    Every component x counts as floor(scale * x). Ties go to the smaller id; a query with fewer candidates gets all of them. Rows
    whose id or vector is null, or whose vector is empty or holds a null or non-finite component, take no part. A
    query meets the vectors of its own length, except rows of its own id. Repeated query ids count once; repeated other rows are
    candidates each. Empty tables give an empty table; other columns are ignored.
    """

    def shape(df: DataFrame) -> DataFrame:
        return df.where(finite(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), scaled(vector_col, scale).alias("_v"), F.size(vector_col).alias("_dims"))

    points, asked = shape(vectors), shape(queries).dropDuplicates(["_id"])
    shards = shards_of(points.count(), SHARD, MOST)
    points = points.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shards)).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done = None, 0
    while done < shards:
        until = min(shards, done + max(1, done * WAVE))
        wave = asked.withColumn("_bound", F.lit(None).cast("double"))
        if best is not None:
            known = best.groupBy(F.col("query_id").alias("_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("_bound"))
            wave = asked.join(known, "_id", "left")
        wave = wave.select("*", F.explode(F.sequence(F.lit(done), F.lit(until - 1))).alias("_shard"))
        found = meet(points.where(F.col("_shard").between(done, until - 1)), wave, Shard, _search(k), "query_id bigint, vec_id bigint, score bigint", until - done)
        found = found if best is None else best.unionByName(found)
        best = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        done = until
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL for ten largest products of each hundredth vector, at a scale of 1,024."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x::DOUBLE) OR isinf(x::DOUBLE))) = 0),
     q AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id) = 1),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """

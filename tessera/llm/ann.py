"""Approximate nearest neighbours over balanced posting lists.

Vectors are dealt to shards by id. In a shard, centroids come from a balanced clustering of a bounded sample; every vector is then put on a
list, and one near a boundary on those of several clusters. A query finds its nearest centroids by best-first search in a graph of
centroids kept in memory, and reads the lists whose centroid is at most a given ratio farther than its nearest one, which is fitted on a
bounded sample of the whole table. Every shard answers every
query, so the number of lists grows with the table, and no task holds more than a shard.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._shards import finite, meet, shards_of

#: Vectors of a shard: so many, and as many at most; of those, vectors that centroids are fitted on at most.
SHARD, MOST, SAMPLE = 32_768, 262_144, 65_536
#: Vectors that a list should have.
LIST = 24
#: A vector joins lists up to this ratio beyond its nearest centroid's distance, at most COPIES lists (the nearest first).
SPREAD, COPIES = 1.005, 2
#: A query reads lists up to a ratio beyond its nearest centroid's distance. Each shard fits the ratio on about so many vectors of the whole table, to this
#: recall of their nearest neighbours in the shard. Most of many shards' vectors are strangers to each, and farther from its centroids than those that the
#: centroids were fitted on, as most queries are; so one rule holds for any number of shards.
TRIED, RECALL = 512, 0.93
GRAPH = 24


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of about equal clusters: two-means splits of the largest cluster at the median."""
    rng = np.random.default_rng(7)
    parts = [(-len(sample), 0, np.arange(len(sample)))]  # a heap: the largest first, then the oldest
    for made in range(1, max(1, min(lists, len(sample)))):
        _, _, rows = heappop(parts)
        points = sample[rows]
        axis = points[rng.integers(len(rows))] - points[rng.integers(len(rows))]
        half = len(rows) // 2
        for _ in range(rounds):
            order = np.argpartition(points @ axis, half)
            axis = points[order[half:]].mean(axis=0) - points[order[:half]].mean(axis=0)
        order = np.argpartition(points @ axis, half)
        heappush(parts, (half - len(rows), 2 * made, rows[order[half:]]))
        heappush(parts, (-half, 2 * made + 1, rows[order[:half]]))
    centres = np.array([sample[x].mean(axis=0) for _, _, x in parts])
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(size > 0, size, 1)


class Graph:
    """Centroids joined to their nearest ones, and to some at random so that all can be reached."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        n = len(centres)
        near = min(GRAPH, n - 1)
        rows = []
        for i in range(0, n, 1024):
            like = centres[i : i + 1024] @ centres.T
            like[np.arange(len(like)), np.arange(i, i + len(like))] = -2
            rows.append(np.argpartition(-like, near - 1, axis=1)[:, :near] if near else np.empty((len(like), 0), int))
        self.linked = np.hstack([np.vstack(rows), np.random.default_rng(11).integers(0, n, (n, 4))])

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids within ``ratio`` of the nearest one's distance: from one start, all seen ones within reach are expanded until none is left."""
        distance = np.full(len(self.centres), np.inf)
        expanded = np.zeros(len(self.centres), bool)
        new = np.zeros(1, np.int64)
        while True:
            distance[new] = np.sqrt(np.maximum(0.0, 2 - 2 * (self.centres[new] @ q)))
            near = distance <= distance.min() * ratio
            front = np.flatnonzero(near & ~expanded)
            if not len(front):
                return np.flatnonzero(near)
            expanded[front] = True
            reached = np.zeros(len(distance), bool)
            reached[self.linked[front]] = True
            new = np.flatnonzero(reached & np.isinf(distance))


class Lists:
    """A shard's index. Rows with one vector are one entry, which lists their ids; all others are entries of their own."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, neighbours: int = 5, tried: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        _, first, entry = np.unique(np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(entry, kind="stable")
        self.ids, self.cuts = ids[order][by], np.r_[0, np.cumsum(np.bincount(entry))]
        self.vectors = vectors[order][first]
        self.lengths = lengths(self.vectors)
        self.units = self.vectors / self.lengths[:, None]
        n = len(self.units)
        sample = self.units[:: -(-n // SAMPLE)]
        self.graph = Graph(balanced_centroids(sample, max(1, n // LIST)))
        lists, entries = [], []
        copies = min(COPIES, len(self.graph.centres))
        for i in range(0, n, 4096):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.units[i : i + 4096] @ self.graph.centres.T)))
            top = np.argpartition(d, copies - 1, axis=1)[:, :copies]
            near = np.take_along_axis(d, top, axis=1)
            rows, cols = np.nonzero(near <= SPREAD * near.min(axis=1, keepdims=True))
            lists.append(top[rows, cols])
            entries.append(rows + i)
        lists, entries = np.concatenate(lists), np.concatenate(entries)
        self.ratio = self._fitted(lists, entries, neighbours, tried)
        self.entries = entries[np.argsort(lists, kind="stable")]
        self.starts = np.r_[0, np.cumsum(np.bincount(lists, minlength=len(self.graph.centres)))]

    def _fitted(self, lists: np.ndarray, entries: np.ndarray, neighbours: int, tried: np.ndarray | None) -> float:
        """The ratio within which the lists of a share RECALL of the tried vectors' nearest neighbours are. Where fewer than TRIED come, own ones fill up."""
        n = len(self.units)
        k = min(neighbours, n - 1)
        if not k:
            return 1.0
        asks = np.empty((0, self.units.shape[1])) if tried is None else tried / lengths(tried)[:, None]
        if len(asks) < TRIED:
            asks = np.vstack([asks, self.units[np.unique(np.linspace(0, n - 1, TRIED - len(asks)).astype(int))]])
        like = asks @ self.units.T
        like[like >= 1 - 1e-12] = -2  # itself
        best = np.argpartition(-like, k - 1, axis=1)[:, :k]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (asks @ self.graph.centres.T)))
        d /= np.maximum(d.min(axis=1, keepdims=True), 1e-12)
        first = np.searchsorted(entries, best)  # entries come in order, each on one list or more
        needed = np.minimum.reduce([np.where(entries[at := np.minimum(first + c, len(entries) - 1)] == best, np.take_along_axis(d, lists[at], axis=1), np.inf) for c in range(COPIES)])
        return float(np.quantile(needed, RECALL, method="higher"))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query's position, id, exact cosine) of each query's k nearest on the lists that it reads, and the cosines that were worked out."""
        units = queries / lengths(queries)[:, None]
        reading = [self.graph.search(q, self.ratio) for q in units]
        who = np.repeat(np.arange(len(units)), [len(x) for x in reading])
        lists = np.concatenate(reading)
        order = np.argsort(lists, kind="stable")
        who, lists = who[order], lists[order]
        cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        limit = np.full(len(units), -np.inf)
        self.own = own = self.repeats(query_ids)  # rows of the query's own id may be entries, of which none counts
        found: list[tuple[np.ndarray, ...]] = []
        held = work = 0
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lists)], strict=True):
            rows, asks = self.entries[self.starts[lists[a]] : self.starts[lists[a] + 1]], who[a:b]
            scores = units[asks] @ self.units[rows].T
            work += scores.size
            i, j = np.nonzero(scores >= limit[asks][:, None])
            found.append((asks[i], rows[j], scores[i, j]))
            held += len(i)
            if held > 200_000:
                found = [self._best(found, limit, k)]
                held = len(found[0][0])
        asks, rows, _ = self._best(found, limit, k)
        # The ids of each entry: of one entry's, the k smallest that aren't the query's own are all that can matter.
        sizes = np.minimum(np.diff(self.cuts)[rows], k + own[asks])
        each = np.repeat(np.arange(len(rows)), sizes)
        offset = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        asks, rows, ids = asks[each], rows[each], self.ids[self.cuts[rows][each] + offset]
        return asks, rows, ids, work

    def repeats(self, query_ids: np.ndarray) -> np.ndarray:
        """Rows of each query's own id."""
        known = np.sort(self.ids)
        return np.searchsorted(known, query_ids, "right") - np.searchsorted(known, query_ids, "left")

    def _best(self, found, limit: np.ndarray, k: int):
        """What can still be among a query's k best entries besides its own; ``limit`` is raised to what that takes."""
        asks, rows, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        _, one = np.unique(asks * len(self.units) + rows, return_index=True)  # an entry may be on several lists
        asks, rows, scores = asks[one], rows[one], scores[one]
        order = np.lexsort((-scores, asks))
        asks, rows, scores = asks[order], rows[order], scores[order]
        start = np.r_[True, asks[1:] != asks[:-1]]
        place = np.arange(len(asks)) - np.maximum.accumulate(np.where(start, np.arange(len(asks)), 0))
        last = place == k + self.own[asks]
        # A little lower, as these cosines may differ from the exact ones in their last bits.
        limit[asks[last]] = scores[last] - 1e-9
        good = scores >= limit[asks]
        return asks[good], rows[good], scores[good]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _search(k: int):
    def search(index: Lists, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        asks, rows, ids, _ = index.nearest(query_ids, queries, k)
        other = ids != query_ids[asks]
        asks, rows, ids = asks[other], rows[other], ids[other]
        # The measure itself, summed in one fixed order whatever the vectors' places.
        scores = (queries[asks] * index.vectors[rows]).sum(axis=1) / (lengths(queries)[asks] * index.lengths[rows])
        order = np.lexsort((ids, -scores, asks))
        asks, ids, scores = asks[order], ids[order], scores[order]
        start = np.r_[True, asks[1:] != asks[:-1]]
        place = np.arange(len(asks)) - np.maximum.accumulate(np.where(start, np.arange(len(asks)), 0))
        good = place < k
        return pa.RecordBatch.from_arrays([pa.array(query_ids[asks[good]]), pa.array(ids[good]), pa.array(scores[good])], ["query_id", "vec_id", "score"])

    return search


def _tried(points: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """About TRIED vectors of the whole table, by their length: those with the least remainder of a hash, each once."""
    share = F.xxhash64("_id", "_v")
    found = points.select("_v", share.alias("_h")).where(F.pmod("_h", F.lit(max(1, rows))) < TRIED).dropDuplicates(["_h"]).orderBy("_h").collect()
    by: dict[int, list[list[float]]] = {}
    for r in found:
        by.setdefault(len(r._v), []).append(r._v)
    return {dims: np.array(x) for dims, x in by.items()}


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found by cosine in double precision.

    Scores are exact, on the original vectors; ties go to the smaller id. Rows whose id or vector is null, or whose vector is empty, zero
    or holds a null or non-finite component, take no part. A query meets the vectors of its own length, except rows of its own id. Repeated query ids count once;
    repeated other rows are candidates each. A query meets all vectors on the lists that it reads, however long these are. Empty tables give
    an empty table; other columns are ignored.
    """
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))

    def shape(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        return df.where(finite(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_v"), F.size(vector_col).alias("_dims")).where(length > 0)

    points, asked = shape(vectors), shape(queries).dropDuplicates(["_id"])
    rows = points.count()
    shards = shards_of(rows, SHARD, MOST)
    tried = _tried(points, rows)
    points = points.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    asked = asked.select("*", F.lit(None).cast("double").alias("_bound"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    found = materialise(meet(points, asked, lambda ids, x: Lists(ids, x, k, tried.get(x.shape[1])), _search(k), "query_id bigint, vec_id bigint, score double", shards), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Vectors in shards and queries that are streamed to each of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a shard answers at once.
BLOCK = 1024


def finite(vector: str) -> F.Column:
    """Vectors with components, none of them null or not finite."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def shards_of(rows: int, least: int, most: int) -> int:
    """How many shards: of ``least`` vectors each, and once these are 64, of more and more, up to ``most`` that a task can hold."""
    return max(1, -(-rows // min(most, max(least, rows // 64))))


def meet(points: DataFrame, asked: DataFrame, build: Callable, search: Callable, out: str, tasks: int) -> DataFrame:
    """Each shard's index is built once, and its queries are streamed to it in blocks.

    points: ``_id``, ``_v``, ``_dims``, ``_shard``; asked: those and ``_bound`` (double, may be null). ``build`` makes an index of ids and a matrix;
    ``search`` answers an index, ids, a matrix and bounds with a record batch. A task holds one shard's vectors and a block of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, parts = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dims, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if key != (shard[a], dims[a]):
                    key, index, parts = (shard[a], dims[a]), None, []
                part = batch.slice(a, b - a)
                ids, matrix = part.column(3).to_numpy(), part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not asks[a]:
                    parts.append((ids.copy(), matrix.copy()))
                    continue
                if parts:
                    index, parts = build(*(np.concatenate([p[i] for p in parts]) for i in range(2))), []
                if index is None:
                    continue
                bounds = part.column(5).to_numpy(zero_copy_only=False).astype(float)
                bounds = np.where(np.isnan(bounds), -np.inf, bounds)
                for i in range(0, b - a, BLOCK):
                    yield search(index, ids[i : i + BLOCK], matrix[i : i + BLOCK], bounds[i : i + BLOCK])

    columns = ["_shard", "_dims", "_asks", "_id", "_v", "_bound"]
    rows = points.withColumns({"_asks": F.lit(False), "_bound": F.lit(None).cast("double")}).select(*columns)
    rows = rows.unionByName(asked.withColumn("_asks", F.lit(True)).select(*columns))
    dealt = rows.repartition(tasks, "_shard", "_dims").sortWithinPartitions("_shard", "_dims", "_asks")
    return dealt.mapInArrow(run, out)

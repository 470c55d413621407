"""Ordered analytics: islands, nearest and as-of joins, interval absorption, offset tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import materialise


def _dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in ranges of keys and order, ``_part`` by ``_part``: a key with very many rows has several parts, so no window holds all of them.

    What a part needs of those before it is carried on by a window over parts, of which there are few.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, keys: list[str], column: str, how) -> DataFrame:
    """``how`` of a column over the parts before each."""
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(column, how(F.col(column)).over(w))


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: Column | int) -> DataFrame:
    """Intervals of a key merged where the next starts at most ``gap`` after all before it end."""
    dealt = _dealt(rows, keys, [start, end])
    order = Window.partitionBy(*keys, "_part").orderBy(start, end)
    ends = _before(dealt.groupBy(*keys, "_part").agg(F.max(end).alias("_reached")), keys, "_reached", F.max)
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    marked = dealt.join(ends, [*keys, "_part"]).withColumn("_reach", reach).withColumn("_new", F.coalesce((F.col(start) - F.col("_reach") > gap).cast("int"), F.lit(1)))
    marked = materialise(marked.withColumn("_own", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "_part", start, end, "_new", "_own"), "marked")
    counts = _before(marked.groupBy(*keys, "_part").agg(F.sum("_new").alias("_sofar")), keys, "_sofar", F.sum)
    numbered = marked.join(counts, [*keys, "_part"]).withColumn("_island", F.col("_own") + F.coalesce("_sofar", F.lit(0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").cast("bigint").alias("n")).drop("_island")


def absorbed(blobs: DataFrame, extents: DataFrame, keys: list[str], share: float = 0.5, cell: int = 4096) -> DataFrame:
    """Blobs (start, stop) of which some one extent covers at least that share.

    Both sides are cut into cells, so the overlap test is an equi-join; overlaps of one extent are summed over cells, those of several aren't.
    """
    cut = lambda df, a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / cell))).alias("_cell")
    left = blobs.select(*keys, F.col("start").alias("_a"), F.col("stop").alias("_b")).distinct()
    left = left.select("*", cut(left, "_a", "_b"))
    right = extents.select(*keys, F.col("start").alias("_c"), F.col("stop").alias("_d")).distinct()
    right = right.select("*", cut(right, "_c", "_d"))
    pairs = left.join(right, [*keys, "_cell"]).where("_c < _b and _a < _d").select(*keys, "_a", "_b", "_c", "_d").distinct()
    covered = pairs.where((F.least("_b", "_d") - F.greatest("_a", "_c")) >= share * (F.col("_b") - F.col("_a")))
    return covered.select(*keys, F.col("_a").alias("start"), F.col("_b").alias("stop")).distinct()


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, forward: bool = False) -> DataFrame:
    """Each left row with the right value at the last place not after it (or the first not before it): a union in order, no range join."""
    l = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_va": F.lit(None).cast(right.schema[right_at].dataType)})  # noqa: E741
    names = [c for c in left.columns if c not in keys]
    r = right.select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(right_at).alias("_at"), F.lit(2 if forward else 0).alias("_side"), F.col(value).alias("_v"), F.col(right_at).alias("_va"))
    both = l.unionByName(r)
    if forward:  # the same from the end: places and sides are turned round
        both = both.withColumns({"_at": -F.col("_at"), "_side": -F.col("_side")})
    dealt = _dealt(both, keys, ["_at", "_side"])
    w = Window.partitionBy(*keys, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = dealt.where("_va is not null").groupBy(*keys, "_part").agg(F.max_by(F.struct("_v", "_va"), F.struct("_at", "_side")).alias("_last"))
    parts = dealt.select(*keys, "_part").distinct().join(known, [*keys, "_part"], "left")
    carried = _before(parts, keys, "_last", lambda c: F.last(c, ignorenulls=True))
    here = F.last(F.when(F.col("_va").isNotNull(), F.struct("_v", "_va")), ignorenulls=True).over(w)
    out = dealt.withColumn("_here", here).where(F.abs("_side") == 1).join(carried, [*keys, "_part"])
    found = F.coalesce("_here", "_last")
    return out.select(*left.columns, found["_v"].alias("asof_value"), found["_va"].alias("asof_at"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, reach: float) -> DataFrame:
    """Each left row with the nearest right place within reach (the earlier one of two as near)."""
    back = asof(left, right.withColumn("_p", F.col(right_at)), keys, at, right_at, "_p").withColumnsRenamed({"asof_value": "_before"}).drop("asof_at")
    both = asof(back, right.withColumn("_p", F.col(right_at)), keys, at, right_at, "_p", forward=True).withColumnRenamed("asof_value", "_after").drop("asof_at")
    a, b = F.col(at) - F.col("_before"), F.col("_after") - F.col(at)
    best = F.when(F.col("_after").isNull() | (a <= b), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("nearest_at", F.when(F.abs(best - F.col(at)) <= reach, best)).drop("_before", "_after")


def table_regions(entries: DataFrame, keys: list[str], offset: str, end: str) -> DataFrame:
    """Entries of an offset table: each runs to the next or to the end; those that lie beyond it are dropped."""
    w = Window.partitionBy(*keys).orderBy(offset)
    ok = entries.where((F.col(offset) >= 0) & (F.col(offset) < F.col(end)))
    return ok.withColumn("stop", F.coalesce(F.lead(offset).over(w), F.col(end))).withColumn("length", F.col("stop") - F.col(offset))


def marker_tempos(markers: DataFrame, keys: list[str], beat: str, seconds: str) -> DataFrame:
    """60 * beats / seconds between neighbouring markers; equal times make none."""
    w = Window.partitionBy(*keys).orderBy(seconds, beat)
    step = markers.withColumns({"_b": F.lead(beat).over(w) - F.col(beat), "_s": F.lead(seconds).over(w) - F.col(seconds)})
    return step.where("_s > 0").withColumn("tempo", F.round(60.0 * F.col("_b") / F.col("_s"), 6)).drop("_b", "_s")


def autocorrelation(rows: DataFrame, keys: list[str], order: list[str], value: str, lags: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Sums of products of deviations a lag apart, over the sum of squares."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    dev = rows.join(means, keys).withColumn("_d", F.col(value) - F.col("_mean"))
    w = Window.partitionBy(*keys).orderBy(*order)
    dev = dev.withColumns({f"_l{k}": F.lead("_d", k).over(w) for k in lags})
    square = F.sum(F.col("_d") * F.col("_d"))
    return dev.groupBy(*keys).agg(*[F.round(F.when(square == 0, 0.0).otherwise(F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)) / square), 6).alias(f"lag{k}") for k in lags])


def sliding(rows: DataFrame, keys: list[str], at: str, size: int, step: int) -> DataFrame:
    """Rows with each window [start, start + size) that holds them; starts are multiples of step."""
    last = F.floor(F.col(at) / step)
    first = F.floor((F.col(at) - size) / step) + 1
    return rows.withColumn("window_start", F.explode(F.transform(F.sequence(F.greatest(first, F.lit(0)), last), lambda i: i * step)))


def running_offsets(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Where each of a row of pieces starts: the sum of the sizes before it, in its part and in all parts before that."""
    dealt = _dealt(rows, keys, order)
    w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = _before(dealt.groupBy(*keys, "_part").agg(F.sum(size).alias("_sofar")), keys, "_sofar", F.sum)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return inside.join(sums, [*keys, "_part"]).withColumn("offset", (F.col("_inside") + F.coalesce("_sofar", F.lit(0))).cast("bigint")).select(*rows.columns, "offset")

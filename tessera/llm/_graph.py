"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, measured_lookup


#: Edges of a file.
ROWS = 200_000


def _stars(edges: DataFrame, by: str, other: str) -> DataFrame:
    """``by``, ``other``, ``m``: each row with the least of its key's others and the key itself."""
    least = edges.groupBy(by).agg(F.min(other).alias("_m"))
    return measured_lookup(edges, least, by, F.col(other), 50_000).select(F.col(by).alias("_by"), F.col(other).alias("_other"), F.least(by, "_m").alias("_least"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _stars(both, "u", "v").where("_other > _by").select(F.col("_other").alias("u"), F.col("_least").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _stars(down, "u", "v")
    pairs = stars.select(F.col("_other").alias("u"), F.col("_least").alias("v")).unionByName(stars.select(F.col("_by").alias("u"), F.col("_least").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the component's least node) of every node that an edge names; roots too.

    Both stages need only a key's least neighbour, which is aggregated before the shuffle; no key's neighbours are
    gathered. Each round is written to the shared folder. The number of rounds grows with the logarithm of
    the longest chain.
    """
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    files = lambda rows: max(1, rows // ROWS)

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = print_of(now)
    while seen[0]:
        # As many files as the rows need: most rounds have few.
        both = materialise(_large(now).coalesce(files(2 * seen[0])), "edges")
        now = materialise(_small(both).coalesce(files(seen[0])), "edges")
        after = print_of(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

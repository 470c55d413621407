"""Harmonic compatibility and similarity by feature vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import music
from tessera.sources.scratch import materialise

#: Relations of the neighbours on the wheel in order, and the ranks of relations.
RELATIONS = ["same key", "relative", "perfect fourth", "perfect fifth"]
KEY_RANK = {"same key": 0, "relative": 1, "perfect fifth": 2, "perfect fourth": 3}
BPM_RANK = {"same tempo": 0, "half-time": 1, "double-time": 1}


def find_compatible(rows: DataFrame, key: str | None, bpm: float | None, tolerance: float = 0.06, half_double: bool = True, kind: str = "any", same_key_only: bool = False, include_relative: bool = True, min_duration: float | None = None, limit: int | None = 50) -> DataFrame:
    """Rows that fit a key and a tempo, best first.

    Without a key only rows without one fit; with one, rows need one on the same place of the wheel or next to it. A row's tempo must lie in
    a window around the tempo, its half or its double. No limit comes before these tests. At most four codes and three windows
    are literals, so the scan isn't joined with anything.
    """
    rows = rows.where(within_kind(kind))
    if min_duration is not None:
        rows = rows.where(F.col("duration") >= min_duration)
    if bpm:
        centres = [(bpm, "same tempo")] + ([(bpm / 2, "half-time"), (bpm * 2, "double-time")] if half_double else [])
        spans = [(c * (1 - tolerance), c * (1 + tolerance), name) for c, name in centres]
        # A plain condition that reaches the scan; which of the windows a row is in is worked out for what is left.
        rows = rows.where(reduce(lambda x, y: x | y, [F.col("bpm").between(low, high) for low, high, _ in spans]))
    no_key = F.col("key").isNull() | (F.col("key") == "")
    if key is None:
        rows = rows.where(no_key).withColumn("_key", F.lit(None).cast("string"))
    else:
        fits = music.related(key)
        relation = {name: RELATIONS[fits[k]] for name, k in music.spellings().items() if k in fits}
        rows = rows.where(~no_key).withColumn("_key", music.looked_up(F.col("key"), relation) if relation else F.lit(None).cast("string")).where("_key is not null")
        if same_key_only:
            rows = rows.where("_key = 'same key'")
        if not include_relative:
            rows = rows.where("_key <> 'relative'")
    if bpm:
        places = [F.when(F.col("bpm").between(low, high), F.struct(F.abs(F.col("bpm") - (low + high) / 2).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (low, high, name) in enumerate(spans)]
        rows = rows.withColumn("_tempo", F.array_min(F.array_compact(F.array(*places))))
    else:
        rows = rows.withColumn("_tempo", F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("name")))
    rank = lambda column, ranks, none: F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[column], F.lit(none))
    label = F.concat_ws(", ", "_key", "_tempo.name")
    out = rows.withColumns(
        {
            "compatibility": F.when(label == "", "compatible").otherwise(label),
            "rank": (rank(F.col("_key"), KEY_RANK, 4) * 3 + rank(F.col("_tempo.name"), BPM_RANK, 2)).cast("int"),
            "bpm_dist": F.round("_tempo.d", 6),
        }
    ).drop("_key", "_tempo")
    first = Window.partitionBy("path").orderBy("rank", "bpm_dist", "library")
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.orderBy("rank", "bpm_dist", "path").limit(limit) if limit is not None else out


def within_kind(kind: str):
    if kind == "loop":
        return (F.col("acid_beats") > 0) | (F.col("duration") >= 2.0)
    if kind == "one_shot":
        return (F.col("acid_beats").isNull() | (F.col("acid_beats") == 0)) & (F.col("duration").isNull() | (F.col("duration") < 1.0))
    return F.lit(True)


def find_similar(features: DataFrame, target_id: int, current: int = 3, kind: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every current vector's standardised cosine to a target's, its percentile among the candidates and its distance from their mean.

    Means and deviations (divisor n; 1 where there is none) are over the candidates and the target. The percentile is the share of candidates strictly below.
    Moments are aggregated by dimension with map-side partial sums, and come back as one row: as many numbers as a vector has.
    """
    rows = features.where(F.col("version") == current)
    if kind:
        rows = rows.where(within_kind(kind) | (F.col(id_col) == target_id))
    target = rows.where(F.col(id_col) == target_id).select(vector_col).first()[0]
    dims = len(target)
    at = lambda i: F.get(F.col(vector_col), i).cast("double")
    moments = rows.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(dims)], *[F.stddev_pop(at(i)).alias(f"s{i}") for i in range(dims)]).first()
    means = [moments[f"m{i}"] for i in range(dims)]
    spreads = [moments[f"s{i}"] or 1.0 for i in range(dims)]
    z = [(float(t) - m) / s for t, m, s in zip(target, means, spreads, strict=True)]
    length = sum(x * x for x in z) ** 0.5
    unit = F.array(*[F.lit(x) for x in z])
    scaled = F.zip_with(F.zip_with(F.col(vector_col), F.array(*map(F.lit, means)), lambda x, m: x.cast("double") - m), F.array(*map(F.lit, spreads)), lambda x, s: x / s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(dot(scaled, scaled)) * F.lit(length)
    out = rows.where(F.col(id_col) != target_id).withColumn("similarity", F.round(F.when(own == 0, 0.0).otherwise(dot(scaled, unit) / own), 6))
    # Each cosine is worked out once. Percentiles by counts of equal similarities: candidates aren't sorted in one task, only their distinct values are.
    out = materialise(out.select(id_col, "label", "similarity"), "similarities")
    totals = out.agg(F.count("*").alias("n"), F.avg("similarity").alias("mean")).first()
    counts = out.groupBy("similarity").agg(F.count("*").alias("_c"))
    bins = counts.withColumn("_bin", F.floor(F.col("similarity") * 500))
    under_bin = bins.groupBy("_bin").agg(F.sum("_c").alias("_b"))
    below = under_bin.withColumn("_under", F.sum("_b").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("_c").over(Window.partitionBy("_bin").orderBy("similarity").rowsBetween(Window.unboundedPreceding, -1))
    ranked = bins.withColumn("_inside", inside).join(F.broadcast(below.select("_bin", "_under")), "_bin")
    ranked = ranked.select("similarity", (F.coalesce("_under", F.lit(0)) + F.coalesce("_inside", F.lit(0))).alias("_below"))
    # Six decimals from -1 to 1: at most 2,000,001 rows, so they may be broadcast, and a frequent similarity is no hot key.
    out = out.join(F.broadcast(ranked), "similarity")
    return out.select(id_col, "label", "similarity", F.round(100.0 * F.col("_below") / F.lit(totals["n"] or 1), 1).alias("percentile"), F.round(F.col("similarity") - F.lit(totals["mean"]), 6).alias("above_mean"))


def estimate_key(chroma: DataFrame, group: str, pitch: str = "pc", energy: str = "energy", detailed: bool = False) -> DataFrame:
    """The best of 24 keys for each group's twelve pitch-class energies, and its lead over the best key of another root.

    Correlations with rotated profiles; a flat chroma correlates 0. Fewer than three pitch classes of at least 2 % of the peak make no key.
    ``detailed``: a confidence from that lead (0.15 is sure), whether the relative key is nearly as good, and the next three keys.
    """
    #: The probe-tone profiles of major and minor keys from the tonic up.
    profiles = [
        (0, [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]),
        (1, [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
    ]
    sums = chroma.groupBy(group).agg(*[F.coalesce(F.sum(F.when(F.col(pitch) == p, F.col(energy))), F.lit(0.0)).alias(f"_e{p}") for p in range(12)])
    values = F.array(*[F.col(f"_e{p}") for p in range(12)])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    centred = F.transform("_values", lambda v: v - total(F.col("_values")) / 12)
    sums = sums.select(group, values.alias("_values")).withColumn("_dev", centred).withColumn("_var", total(F.transform("_dev", lambda v: v * v)))
    shapes = []
    for mode, weights in profiles:
        middle = sum(weights) / 12
        length = sum((w - middle) ** 2 for w in weights) ** 0.5
        unit = [(w - middle) / length for w in weights]
        shapes += [F.struct(F.lit(root).alias("root"), F.lit(mode).alias("mode"), F.array(*[F.lit(unit[(p - root) % 12]) for p in range(12)]).alias("w")) for root in range(12)]
    fit = lambda s: F.struct(F.round(F.when(F.col("_var") == 0, 0.0).otherwise(total(F.zip_with(F.col("_dev"), s["w"], lambda a, b: a * b)) / F.sqrt("_var")), 6).alias("r"), (-(s["root"] + 12 * s["mode"])).alias("o"), s["root"].alias("root"), s["mode"].alias("mode"))
    sums = sums.withColumn("_scores", F.transform(F.array(*shapes), fit)).withColumn("_best", F.array_max("_scores"))
    values = F.col("_values")
    rival = F.array_max(F.filter("_scores", lambda s: s["root"] != F.col("_best.root")))
    present = F.size(F.filter(values, lambda v: v >= F.array_max(values) * 0.02))
    named = present >= 3
    if detailed:
        best = F.col("_best")
        relative = F.when(best["mode"] == 0, F.pmod(best["root"] + 9, F.lit(12))).otherwise(F.pmod(best["root"] + 3, F.lit(12)))
        twin = F.array_max(F.filter("_scores", lambda s: (s["root"] == relative) & (s["mode"] != best["mode"])))
        names = F.transform(F.slice(F.reverse(F.array_sort("_scores")), 2, 3), lambda s: music.pitch_name(s["root"], s["mode"]))
        margin = best["r"] - rival["r"]
        return sums.select(group, F.when(named, music.pitch_name(best["root"], best["mode"])).alias("key"), F.when(named, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / 0.15)), 6)).alias("confidence"), F.when(named, best["r"] - twin["r"] < 0.05).alias("ambiguous"), F.when(named, F.array_join(names, ",")).alias("runners_up"))
    return sums.select(group, F.when(named, music.pitch_name(F.col("_best.root"), F.col("_best.mode"))).alias("key"), F.when(named, F.col("_best.r")).alias("correlation"), F.when(named, F.round(F.col("_best.r") - rival["r"], 6)).alias("margin"))

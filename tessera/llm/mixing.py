"""Documents sampled so that token weights meet target shares of several columns at once.

Iterative proportional fitting rakes the token sums of the cells (source x language x topic) to the targets of one column after another,
again and again. A cell's fitted weight over its own sum is the number of copies that each of its documents should have in the mixture.

DataFrame operations only: documents are aggregated to cells once, all fitting is on the table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

NONE = "(none)"
#: Rounds of raking, and how many of them are planned as one job.
ROUNDS, TOGETHER = 8, 2
DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the natural shares that give the targets: below 1 they are evened out.
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Tokens of the mixture over tokens of the input.
BUDGET = 0.5


def count_tokens(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds: the first rule that fits."""
    return (
        F.when(F.contains(text, F.lit("icense")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("!!")), "shout")
        .when(F.length(text) < 600, "note")
        .when(F.length(text) < 4000, "article")
        .when(text.isNotNull(), "long")
        .otherwise(NONE)
    )


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    topic = topic_of(F.col(text_col)) if topic is None else topic
    return docs.select(F.col(id_col).alias("_id"), name(source_col).alias("source"), name(lang_col).alias("lang"), F.coalesce(topic, F.lit(NONE)).alias("topic"), count_tokens(F.col(text_col)).alias("tokens"))


def calibrate(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, ``tokens``) with ``weight``, raked to each dimension's ``share`` (a table of value and share).

    Weights sum to 1. A cell without tokens weighs nothing; a value without a target share weighs nothing.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, shares in targets.items():
        now = now.join(shares.select(d, F.col("share").alias(f"_to_{d}")), d, "left")
    for r in range(rounds):
        for d in targets:
            # A value's cells are as many as the other columns' values allow, however many documents there are.
            held = F.sum("weight").over(Window.partitionBy(d))
            now = now.withColumn("weight", F.when(held > 0, F.col("weight") * (F.coalesce(f"_to_{d}", F.lit(0.0)) / held)).otherwise(0.0))
        if (r + 1) % TOGETHER == 0 or r + 1 == rounds:
            now = materialise(now, "raked")
    return now.select(*cells.columns, "weight")


def natural_targets(cells: DataFrame, exponents: dict[str, float]) -> dict[str, DataFrame]:
    """Shares of tokens to a power, made to sum to 1."""
    out = {}
    for d, power in exponents.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("_n")).withColumn("_p", F.when(F.col("_n") > 0, F.pow(F.col("_n").cast("double"), F.lit(power))).otherwise(0.0))
        sums = materialise(sums, "targets")
        total = sums.agg(F.sum("_p")).first()[0] or 1.0
        out[d] = sums.select(d, (F.col("_p") / F.lit(total)).alias("share"))
    return out


def mixture(feats: DataFrame, exponents: dict[str, float] | None = None, budget: float = BUDGET, seed: str = "mix", targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every row of ``features`` with ``rate`` (copies wanted) and ``copies`` (0 or more, by a draw from the id).

    ``copies`` is the whole part of the rate, and one more with the rest as its probability, so that expected token sums meet all targets.
    Null sources, languages and topics are a value of their own. A document without tokens is in a cell as any other; cells that hold no
    tokens at all have rate 0. Repeated rows of one id share a draw. An empty table gives an empty table.
    """
    feats = materialise(feats, "features")
    return _with_copies(feats, rates(feats, exponents, budget, targets), F.col("_id"), seed)


def rates(feats: DataFrame, exponents: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Each cell's dimensions and ``rate``."""
    cells = materialise(feats.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or natural_targets(cells, exponents or EXPONENTS)
    raked = calibrate(cells, targets)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    return raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(total) * F.lit(budget) / F.col("tokens"), 6)).otherwise(0.0).alias("rate"))


def _with_copies(rows: DataFrame, rates: DataFrame, key: Column, seed: str) -> DataFrame:
    whole = F.floor("rate")
    return rows.join(rates, list(DIMENSIONS)).withColumn("copies", (whole + (draw(key, seed) < F.col("rate") - whole).cast("bigint")).cast("bigint"))


def sample(docs: DataFrame, id_col: str, text_col: str, exponents: dict[str, float] | None = None, budget: float = BUDGET, seed: str = "mix", targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``mixture`` has copies of it, no row where it has none."""
    found = rates(materialise(features(docs, id_col, text_col), "features"), exponents, budget, targets)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(own, name("source").alias("source"), name("lang").alias("lang"), F.coalesce(topic_of(F.col(text_col)), F.lit(NONE)).alias("topic"))
    # Without a shuffle of the documents: cells are few.
    mixed = _with_copies(rows, F.broadcast(found), F.col(f"_doc.`{id_col}`"), seed)
    return mixed.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def oracle(rounds: int = ROUNDS, exponents: dict[str, float] | None = None, budget: float = BUDGET, seed: str = "mix") -> str:
    """The same in DuckDB SQL."""
    exponents = exponents or EXPONENTS
    tokens = "len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))"
    topic = "CASE WHEN contains(text, 'icense') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '!!') THEN 'shout' WHEN length(text) < 600 THEN 'note' WHEN length(text) < 4000 THEN 'article' WHEN text IS NOT NULL THEN 'long' ELSE '(none)' END"
    parts = [
        f"feats AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic, coalesce({tokens}, 0)::BIGINT AS tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM feats GROUP BY ALL)",
    ]
    for d, power in exponents.items():
        parts.append(f"t_{d} AS (SELECT {d}, p / sum(p) OVER () AS share FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {power}) AS p FROM cells GROUP BY 1))")
    last = "(SELECT *, tokens::DOUBLE AS weight FROM cells)"
    for r in range(rounds):
        for d in exponents:
            parts.append(f"r_{r}_{d} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN s.total > 0 THEN c.weight * (t.share / s.total) ELSE 0 END AS weight FROM {last} c JOIN (SELECT {d}, sum(weight) AS total FROM {last} GROUP BY 1) s USING ({d}) JOIN t_{d} t USING ({d}))")
            last = f"r_{r}_{d}"
    parts.append(f"rates AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(weight * (SELECT sum(tokens)::DOUBLE FROM cells) * {budget} / tokens, 6) ELSE 0 END AS rate FROM {last})")
    draw_sql = f"(('0x' || substr(md5('{seed}:' || doc_id), 1, 12))::BIGINT / {float(1 << 48)}::DOUBLE)"
    return "WITH " + ", ".join(parts) + f" SELECT * FROM (SELECT doc_id, source, lang, topic, tokens, rate, (floor(rate) + CASE WHEN {draw_sql} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM feats JOIN rates USING (source, lang, topic)) WHERE copies > 0"

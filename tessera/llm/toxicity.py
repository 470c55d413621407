"""Toxicity by the nearest labelled examples.

Examples and texts are TF-IDF vectors over words and word beginnings that tell the labels apart. The k nearest examples by
exact cosine come from an inverted index whose postings are cut into blocks of examples; a block is skipped when the sum of its terms'
largest weights shows that it can't hold one of the k. Their votes, weighted by similarity and by what each sampled example stands
for, give a raw score, and the examples are the evidence. A monotone map, fitted on the examples themselves with each left out of its own
neighbours, makes a probability of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that are learnt from, of each label: the bound of the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Terms of the vectors: all that are seen in so many examples, with at least this log-likelihood ratio and this ratio of their rates among the labels.
#: Others tell the labels apart no better than chance does. Their number is bounded by the sample's.
LEAST_SEEN, LEAST_RATIO, LEAST_LIFT = 4, 15.0, 4.0
NEIGHBOURS, BLOCK, SHRINK = 15, 64, 0.25
#: Letters of word beginnings, counts that make a term of their own, and words whose terms a worker keeps at hand.
BEGINNINGS, OFTEN, CACHE = (3, 4, 5, 6, 7), (2, 3, 5), 500_000
_WORDS = re.compile(r"[^\W\d_]+").findall


def beginnings(word: str) -> list[str]:
    """The terms of a word: itself, and its first letters if it is longer."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def often(counts: Counter) -> Counter:
    """Adds terms that say that a term occurs so often: cosines alone don't tell once from often."""
    out = Counter(counts)
    for term, n in counts.items():
        for least in OFTEN:
            if n >= least:
                out[f"{term}#{least}"] = 1
    return out


def terms(text: str) -> Counter:
    out = Counter()
    for w, n in Counter(_WORDS(text.lower())).items():
        for term in beginnings(w):
            out[term] += n
    return often(out)


class Index:
    """A block-max inverted index over labelled examples."""

    def __init__(self, vocabulary: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], shares: tuple[float, float]):
        """vocabulary: idf by term; examples: id, label, term counts; shares: rows that a clean and a toxic example stand for."""
        self.term = {t: i for i, t in enumerate(vocabulary)}
        self.bases = {t.partition("#")[0] for t in vocabulary}
        self._known: dict[str, tuple[str, ...]] = {}
        self.idf = np.array(list(vocabulary.values()) or [0.0])
        rows = []
        for key, label, counts in examples:
            ids, weights = self.vector(counts)
            rows.append((int(ids[np.argmax(weights)]) if len(ids) else -1, key, label, ids, weights))
        empty = [r for r in rows if not len(r[3])]
        worth = lambda r: shares[1] if r[2] else shares[0]
        total = sum(map(worth, rows)) or 1.0
        self.prior = sum(worth(r) for r in rows if r[2]) / total
        # A text without any known term is nearest to the examples without one.
        self.without = (sum(worth(r) for r in empty if r[2]) + self.prior * SHRINK) / (sum(map(worth, empty)) + SHRINK)
        rows = sorted((r for r in rows if len(r[3])), key=lambda r: (r[0], r[1]))  # alike examples share blocks
        self.keys = np.array([r[1] for r in rows], dtype=np.int64)
        self.labels = np.array([r[2] for r in rows], dtype=np.float64)
        self.worth = np.array([worth(r) for r in rows]) / max(shares[0], 1e-9)
        blocks = -(-len(rows) // BLOCK)
        self.top = np.zeros((len(self.idf), blocks))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.idf]
        for n, r in enumerate(rows):
            for t, w in zip(r[3].tolist(), r[4].tolist(), strict=True):
                postings[t].append((n, w))
                self.top[t, n // BLOCK] = max(self.top[t, n // BLOCK], w)
        self.rows = [np.array([n for n, _ in p], dtype=np.int64) for p in postings]
        self.weights = [np.array([w for _, w in p]) for p in postings]
        self.cuts = [np.searchsorted(r, np.arange(blocks + 1) * BLOCK) for r in self.rows]
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.vectors, self.empty, self.shares = [r[3:] for r in rows], [float(r[2]) for r in empty], shares
        self.reliability: list[tuple[float, float, float]] = []

    def left_out(self, n: int) -> float:
        """The raw score of an example, itself left out of its neighbours."""
        return self._raw(*self.vectors[n], n)[0]

    def calibrate(self, left_out: list[float]) -> None:
        """Fits the map from raw scores to probabilities: the monotone one of least squares over all examples, weighted by what they stand for.

        left_out: left_out() of each example. ``reliability`` then has the steps: (mean raw score, rate of label 1, weight).
        """
        empty, shares = self.empty, self.shares
        raw = [*left_out] + [self.without] * len(empty)
        labels = np.r_[self.labels, empty]
        worth = np.where(labels > 0, shares[1], shares[0])
        if not len(raw) or not worth.sum():
            return
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # weight, weighted labels, weighted scores
        for x, y, w in zip(np.array(raw)[order], labels[order], worth[order], strict=True):
            pools.append([w, w * y, w * x])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.knots = np.array([p[2] / p[0] for p in pools])
        self.levels = np.array([p[1] / p[0] for p in pools])
        self.reliability = [(float(x), float(y), p[0]) for x, y, p in zip(self.knots, self.levels, pools, strict=True)]
        self.vectors = []

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.knots, self.levels))

    def terms(self, text: str) -> Counter:
        """terms() of a text, but only those that the index may hold."""
        out, known = Counter(), self._known
        if len(known) > CACHE:
            known.clear()
        for w, n in Counter(_WORDS(text.lower())).items():
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(t for t in beginnings(w) if t in self.bases)
            for t in own:
                out[t] += n
        return often(out) if out else out

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        known = [(i, n) for t, n in counts.items() if (i := self.term.get(t)) is not None]
        ids = np.array([i for i, _ in known], dtype=np.int64)
        weights = (1 + np.log(np.array([n for _, n in known], dtype=np.float64))) * self.idf[ids]
        return ids, weights / (np.sqrt((weights * weights).sum()) or 1.0)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples that share a term (positions, cosines): exact, ties to the smaller position. ``but``: one that doesn't count."""
        bound = weights @ self.top[ids]
        found, scores, least = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) == k and bound[b] < least):
                break
            block = np.zeros(BLOCK)
            for t, w in zip(ids.tolist(), weights.tolist(), strict=True):
                lo, hi = self.cuts[t][b], self.cuts[t][b + 1]
                if hi > lo:
                    block[self.rows[t][lo:hi] - b * BLOCK] += w * self.weights[t][lo:hi]
            if b * BLOCK <= but < (b + 1) * BLOCK:
                block[but - b * BLOCK] = 0
            hits = np.flatnonzero(block > 0)
            found, scores = np.concatenate([found, hits + b * BLOCK]), np.concatenate([scores, block[hits]])
            order = np.lexsort((found, -scores))[:k]
            found, scores = found[order], scores[order]
            least = scores[-1] if len(scores) else 0.0
        return found, scores

    def _raw(self, ids: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Votes of the nearest examples before they are calibrated, and the examples."""
        if not len(ids):
            return self.without, np.empty(0, np.int64), np.empty(0)
        found, cosines = self.nearest(ids, weights, but=but)
        if not len(found):
            return self.without, found, cosines
        votes = cosines * cosines * self.worth[found]
        scale = SHRINK * float(self.worth.min())
        return float((votes @ self.labels[found] + scale * self.without) / (votes.sum() + scale)), found, cosines

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability, and the positions and cosines of the examples that it rests on."""
        raw, found, cosines = self._raw(*self.vector(self.terms(text)))
        return self.calibrated(raw), found, cosines


def held_out(id_col: str, parts: int, fold: int) -> F.Column:
    """Whether the id's CRC-32 leaves this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: F.Column | None = None) -> Index:
    """Learn from a bounded sample of the labelled rows, chosen by a hash of the id.

    ``learn``: a condition on ``id_col`` of rows that may be learnt from. Rows with a null id, label or text aren't learnt from;
    of repeated labels of one id the larger counts. Without any labelled row every score is 0.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    counts = dict(rows.groupBy("_label").count().collect())
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = rows.where("_label = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(rows.where("_label = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # The sample is bounded, so it may be broadcast: the texts stay where they are.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                seen[label.as_py()].update(terms(text.as_py()).keys())
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][t] for t in part], pa.int64()), pa.array([seen[1][t] for t in part], pa.int64())], ["_term", "_clean", "_toxic"])

    sample = texts.join(F.broadcast(chosen), "_id").select("_text", "_label", "_id")
    total = {0: min(counts.get(0, 0), SAMPLE_CLEAN) + 1.0, 1: min(counts.get(1, 0), SAMPLE_TOXIC) + 1.0}
    a, b = F.col("_clean"), F.col("_toxic")
    seen = sample.select("_text", "_label").mapInArrow(count, "_term string, _clean bigint, _toxic bigint").groupBy("_term").agg(F.sum("_clean").alias("_clean"), F.sum("_toxic").alias("_toxic"))
    expected = (a + b) * F.lit(total[1] / (total[0] + total[1]))
    ratio = 2 * (b * F.log((b + 0.5) / expected) + a * F.log((a + 0.5) / (a + b - expected)))
    lift = ((b + 0.5) / total[1]) / ((a + 0.5) / total[0])
    good = seen.where(a + b >= LEAST_SEEN).withColumn("_ratio", ratio).where((F.col("_ratio") >= LEAST_RATIO) & (lift >= LEAST_LIFT))
    kept = good.orderBy(F.desc("_ratio"), "_term").collect()
    vocabulary = {r["_term"]: float(np.log(1 + sum(total.values()) / (r["_clean"] + r["_toxic"]))) for r in kept}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[(t, n) for t, n in terms(x.as_py()).items() if t in vocabulary] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.string())), pa.array([[n for _, n in x] for x in lists], pa.list_(pa.int32()))], ["_id", "_label", "_terms", "_counts"])

    rows = sample.mapInArrow(project, f"_id {dict(sample.dtypes)['_id']}, _label int, _terms array<string>, _counts array<int>").collect()
    rows.sort(key=lambda r: r["_id"])
    examples = [(r["_id"], r["_label"], dict(zip(r["_terms"], r["_counts"], strict=True))) for r in rows]
    index = Index(vocabulary, examples, (counts.get(0, 0) / max(1, total[0] - 1), counts.get(1, 0) / max(1, total[1] - 1)))
    index.calibrate(_left_out(docs.sparkSession, index))
    return index


def _left_out(spark: SparkSession, index: Index) -> list[float]:
    """left_out() of all examples, whose number is the sample's, worked out by the executors."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.left_out(n) for n in batch.column(0).to_pylist()], pa.float64())], ["id", "raw"])

    n = len(index.vectors)
    rows = spark.range(0, n, 1, max(1, n // 250)).mapInArrow(run, "id bigint, raw double").collect()
    return [r["raw"] for r in sorted(rows)]


def score(docs: DataFrame, index: Index, id_col: str, text_col: str, evidence: bool = False, keep_columns: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``id_col`` (with ``keep_columns`` all columns but any of the new names), the score (0 to 1) and prediction under ``names`` and, with ``evidence``, the examples' ids and cosines.

    Only the text is an input. Null counts as empty; a text without known terms gets the rate of such examples, calibrated. Of examples that are
    as near, those that come first in the index count; the prediction is 1 from a score of 0.5 on. Repeated rows each get a row. A very long text is one
    value in one task, of which words are counted. An empty table gives an empty table. No shuffle: the index is bounded and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.drop(*names, *(["evidence_ids", "evidence_cosines"] if evidence else [])) if keep_columns else docs.select(id_col)
    fields = [T.StructField("_score", T.DoubleType())]
    if evidence:
        fields += [T.StructField("evidence_ids", T.ArrayType(T.LongType())), T.StructField("evidence_cosines", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*rows.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [index.score(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([min(1.0, max(0.0, s)) for s, _, _ in found], pa.float64())]
            if evidence:
                columns += [pa.array([index.keys[r] for _, r, _ in found], pa.list_(pa.int64())), pa.array([c for _, _, c in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *(f.name for f in fields)])

    out = docs.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumn(names[1], (F.col("_score") >= 0.5).cast("int")).withColumnRenamed("_score", names[0])

"""Language identification as inference in a mixture of languages.

Every word of a text is drawn from one language; words have likelihoods under each language's letter n-grams.
Expectation-maximisation estimates the text's language proportions, and the set of languages is the one with the best likelihood
after a penalty for each language in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts learnt from in each language (expected number; chosen by a hash of the id): the bound of the sample.
SAMPLE = 2000
#: N-grams of each order are counted in this many slots by hash.
SLOTS, ORDERS = 1 << 16, (1, 2, 3)
STEPS, PENALTY = 25, 2.0
UNKNOWN = "und"
_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams that end at each letter or word end (a column for each order), and where words start.

    Words are runs of letters, lower-cased; all else is a gap.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return np.empty((0, len(ORDERS)), np.int64), np.empty(0, np.int64)
    codes = np.r_[0, 0, codes, 0]
    here, before, two = codes[2:], codes[1:-1], codes[:-2]
    keep = np.flatnonzero((here > 0) | (before > 0))  # letters, and the gap right after a word
    two = np.where(before == 0, 0, two)
    columns = [here, here * 1_000_003 + before + 1, (here * 1_000_003 + before + 1) * 998_244_353 + two + 7]
    mixed = np.stack([((c[keep] * 0x2545F4914F6CDD1D) >> 40) & (SLOTS - 1) for c in columns], axis=1)
    return mixed, np.flatnonzero((here[keep] > 0) & (before[keep] == 0))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x orders x slots."""
        self.languages = languages
        smooth = counts + 0.05
        self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=2, keepdims=True)).transpose(1, 2, 0)) / len(ORDERS)

    def words(self, text: str) -> np.ndarray:
        """Log-likelihoods, words x languages."""
        slots, starts = grams(text)
        if not len(starts):
            return np.empty((0, len(self.languages)))
        each = sum(self.logs[o][slots[:, o]] for o in range(len(ORDERS)))
        return np.add.reduceat(each, starts, axis=0)

    def mixture(self, likelihoods: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood after expectation-maximisation; likelihoods is words x languages, in logs."""
        top = likelihoods.max(axis=1, keepdims=True)
        p = np.exp(likelihoods - top)
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(STEPS if p.shape[1] > 1 else 0):
            joint = p * share
            new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(np.log(np.maximum(p @ share, 1e-300)).sum() + top.sum())

    def infer(self, text: str | None) -> tuple[list[str], list[float]]:
        """Languages of the chosen set, the largest share first, and their shares."""
        words = self.words(text or "")
        if not len(words) or not self.languages:
            return [], []
        order = np.argsort(-words.sum(axis=0), kind="stable")
        if len(order) > 1:
            share, _ = self.mixture(words)
            order = np.argsort(-share, kind="stable")
        best = None
        for m in range(1, len(order) + 1):
            part = order[:m]
            share, value = self.mixture(words[:, part])
            value -= PENALTY * (m - 1) * np.log(1 + len(words))
            if best is not None and value <= best[0]:
                break
            best = (value, part, share)
        _, part, share = best
        rank = np.argsort(-share, kind="stable")
        return [self.languages[part[i]] for i in rank], share[rank].tolist()


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: F.Column | None = None) -> Model:
    """Count n-grams of a bounded sample of each language's texts.

    Rows with a null id, text or language aren't learnt from. Counts are summed by language, order and slot before they leave the executors.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    sizes = rows.groupBy("_lang").count().orderBy("_lang").collect()
    if not sizes:
        return Model([], np.zeros((0, len(ORDERS), SLOTS)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_lang"], min(1.0, SAMPLE / r["count"]))])
    chance = F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(chance < share[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                slots, _ = grams(text.as_py())
                into = seen.setdefault(lang.as_py(), np.zeros((len(ORDERS), SLOTS), np.int64))
                for o in range(len(ORDERS)):
                    into[o] += np.bincount(slots[:, o], minlength=SLOTS)
        for lang, table in seen.items():
            order, slot = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(order), pa.string()), pa.array(order * SLOTS + slot), pa.array(table[order, slot])], ["_lang", "_slot", "_n"])

    got = chosen.mapInArrow(count, "_lang string, _slot bigint, _n bigint").groupBy("_lang", "_slot").agg(F.sum("_n").alias("_n")).toPandas()
    languages = [r["_lang"] for r in sizes]
    counts = np.zeros((len(languages), len(ORDERS) * SLOTS))
    counts[got["_lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), got["_slot"].to_numpy(int)] = got["_n"]
    return Model(languages, counts.reshape(len(languages), len(ORDERS), SLOTS))


def predict(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (that language's share), ``languages`` and ``shares`` of the chosen set.

    Only the text is an input. A null text, or one without a letter, is ``und`` with score 0 and no languages. Of languages with equal shares the
    first by name counts. Repeated rows each get a row; a very long text is one value in one task; other columns are ignored; an empty table gives an empty table. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.infer(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a[0] if a else UNKNOWN for a, _ in found], pa.string()),
                    pa.array([b[0] if b else 0.0 for _, b in found], pa.float64()),
                    pa.array([a for a, _ in found], pa.list_(pa.string())),
                    pa.array([b for _, b in found], pa.list_(pa.float64())),
                ],
                ["_id", "lang_pred", "score", "languages", "shares"],
            )

    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = docs.mapInArrow(run, f"_id {dict(docs.dtypes)['_id']}, lang_pred string, score double, languages array<string>, shares array<double>")
    return out.withColumnRenamed("_id", id_col)

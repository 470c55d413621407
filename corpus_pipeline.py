"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); docs is the Parquet table that its predecessor wrote. All but the last return the columns of
``documents``. The similarity that near duplicates take, their five-word shingles and the mixture's shares are the stages' parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, mixing, simhash, toxicity
from tessera.llm._common import scratch_path

WORDS, RADIUS, SIMILARITY = 5, 3, "0.8"
#: Token shares of sources and languages are evened out a little; the mixture has as many tokens as its input, so rates above 1 repeat documents.
EXPONENTS, BUDGET = {"source": 0.9, "lang": 0.9, "topic": 1.0}, 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go.

    A null or empty text scores as examples without a known term do. Repeated rows are judged alike; rows with a null id are judged by their text. Without
    labels nothing goes. Columns of any other name stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    scored = toxicity.score(docs, index, "doc_id", "text", keep_columns=True, names=("_points", "_toxic"))
    return scored.where("_toxic = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and n_chars follows; documents stay, even if no line is left.

    Null and empty texts stay so. Of equal lines that of the smallest id and place stays; repeated rows are changed alike, and rows with a null id not
    at all. Columns of any other name stay as they are.
    """
    changed = lines.remove_repeats(docs, "doc_id", "text", counts=False)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that verified similarities link, that of the smallest id stays.

    All texts without words, null ones too, are alike. Repeated rows of the smallest id all stay, and so do rows with a null id. Columns of any other name
    stay as they are.
    """
    found = simhash.similar_documents(docs, "doc_id", "text", words=WORDS, similarity=SIMILARITY, radius=RADIUS)
    later = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source, language and topic are calibrated to: some not at all, some more than once, each copy a row.

    Null sources, languages and topics are values of their own, and a null or empty text has no tokens. Repeated rows of one id share a draw. Columns of
    any other name stay as they are.
    """
    return mixing.sample(docs, "doc_id", "text", exponents=EXPONENTS, budget=BUDGET).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids; a null or empty text has none, and other columns go."""
    return bpe.encode_texts(docs, "doc_id", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", sample_mixture),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the nearest examples nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lines, mixing, simhash, substrings, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, and of the bytes that they decode to."""
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), "doc_id", "text", ids=False, digests=True)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives written from all pages hold of each page."""
    captures = warc.round_trip(_read(spark, sf_dir, "pages"))
    return captures.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.col("response.record_type").alias("record_type"),
        "refers_to",
        F.col("request.target_uri").alias("request_target"),
        warc.field_of(F.col("metadata"), "payloadLength").alias("declared_bytes"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents of a mixture raked to source, language and topic shares, with their rates and copies."""
    feats = mixing.features(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return mixing.mixture(feats).where("copies > 0").select(F.col("_id").alias("doc_id"), *mixing.DIMENSIONS, "tokens", "rate", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles and the component that it belongs to."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), "doc_id", "text", words=3, radius=3)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one, exactly or within one edit."""
    return lines.remove_repeats(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text", "n_lines", "n_removed")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once 50-byte strings of earlier documents are cut."""
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), "doc_id", "text", length=50)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels outside of the held-out fifth, with the nearest labelled example as evidence."""
    docs, held = _read(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 5, 0)
    index = toxicity.fit(docs, _read(spark, sf_dir, "labels"), "doc_id", "text", "toxic", learn=~held)
    scored = toxicity.score(docs, index, "doc_id", "text", evidence=True)
    evidence = (F.get("evidence_ids", 0).alias("nearest_id"), F.round(F.get("evidence_cosines", 0), 6).alias("nearest_cosine"), F.size("evidence_ids").alias("neighbours"))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", *evidence)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's main language, learnt from documents outside of the held-out quarter."""
    docs, held = _read(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 4, 2)
    model = langid.fit(docs, "doc_id", "text", "lang", learn=~held)
    return langid.predict(docs, model, "doc_id", "text").select("doc_id", held.alias("held_out"), "lang_pred", F.round("score", 9).alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors found for each vector whose id is divisible by 50."""
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest integer inner products of each vector whose id is divisible by 100."""
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10, scale=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_warc": op2_warc, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash, "op5_lines": op5_lines, "op6_substrings": op6_substrings, "op7_toxicity": op7_toxicity, "op8_language": op8_language, "op9_ann": op9_ann, "op10_topk": op10_topk}

#: DuckDB SQL for those that SQL can express; the tests hold the others against brute force.
ORACLES: dict[str, str] = {"op2_warc": warc.oracle(), "op3_mixing": mixing.oracle(), "op5_lines": lines.oracle(), "op6_substrings": substrings.oracle(), "op10_topk": topk.oracle()}

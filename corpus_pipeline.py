"""A training corpus from the documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm.mixing import mixed_documents
from metricspark.llm.ngram_join import without_near_duplicates
from metricspark.llm.quality import score_quality, train
from metricspark.llm.secrets import redact_secrets
from metricspark.llm.sentencepiece import encode_pieces
from metricspark.llm.tables import stored

QUALITY_THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = _unused(docs, "score")
    return score_quality(docs, train(docs, labels), name=name).filter(F.col(name) >= QUALITY_THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, null ids last."""
    return without_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and piece ids of every document of the mix."""
    return encode_pieces(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: A trained classifier and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

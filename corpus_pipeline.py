"""Corpus pipeline: language ID, near-dedup, secret scan, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written
as Parquet and read back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, language, mixing, near_dedup, secrets
from ledgerlens.llm.queries import MIX_SEED, crc_class, language_model, vocabulary_path
from ledgerlens.llm.tables import read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learnt language: no text or letters, or far more bits per byte than any held-out labelled
    text of their length needs; a null lang becomes the predicted one. Without labelled documents all stay."""
    model = language_model(docs)
    held_out = docs.where(F.col("lang").isNotNull() & (crc_class(F.col("doc_id"), 4) == 2))
    return language.in_known_language(docs, model, language.rate_bounds(held_out, model))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more) stays."""
    return near_dedup.one_of_each(docs, k=5, percent=80).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; documents stay, ``n_chars`` follows the text."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at equal weight; a document occurs as often as its draw says, in shuffled order."""
    return mixing.mix_sources(docs, seed=MIX_SEED).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every text encoded whole."""
    encoded = bpe.encode_documents(docs, vocabulary_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("secret_scan", secret_scan),
          ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]
#: Language models and BPE are beyond SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs

"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read
again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents; the last returns the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm import decontaminate, exact_dedup, language, minhash, pieces
from rankspark.llm.common import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or of no language that was learned, go."""
    return language.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: the document with the smallest doc_id of each group stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near deduplication: the document with the smallest doc_id of each component stays."""
    return minhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a test item within its error budget go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentence pieces: scores and ids of the N best segmentations (``pieces.encode``)."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: Language inference, sketches, edit matching and token lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""From raw documents to packed training sequences: five stages over the documents table.

Every stage but the last returns the columns of its input. Near-dedup compares texts: rows with one doc_id and different
texts are different documents, repeated rows are one, and rows with a null doc_id are left alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.llm import packing, quality, secrets, simhash, toxicity
from strandbase.llm.common import spread
from strandbase.llm.common import stage as staged


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality threshold go."""
    scored = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)), docs.columns)
    return scored.filter(F.col("__score") >= quality.KEEP_AT).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    scored = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)), docs.columns)
    return scored.filter(F.col("__score") < 0.5).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by shingles of five words, the document with the smallest doc_id stays."""
    return simhash.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows."""
    return secrets.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity_filter", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: The first three stages can't be put in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written in the shared folder and read by the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

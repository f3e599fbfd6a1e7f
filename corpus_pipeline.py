"""Corpus pipeline: from documents to packed batches in five stages.

Every stage reads all that the one before kept, written as Parquet and read again.
The first four return the columns of `documents`; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import line_dedup, packing, quality_rules, secrets, simhash
from cairn.llm.common import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers in their language and source go."""
    return quality_rules.keep_clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document that loses its last words goes with them."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    The SimHash ball of two bits finds near-identical texts only; a document also goes if an earlier one
    has Jaccard 0.8 with it over five-word shingles.
    """
    return line_dedup.without_similar(simhash.keep_first(docs), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: SimHash and secret scans have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs

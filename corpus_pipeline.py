"""Corpus pipeline: filter, deduplicate, decontaminate, mask secrets and pack documents.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the result is
written as Parquet in the shared folder and reread as the next stage's documents.
All stages but the last return the columns of ``documents``. Nulls, empty texts,
repeated rows and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import jaccard, packing, secretscan, tiling, toxicity
from corpusmill.session import read_table, stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in any order of its parts, go."""
    return tiling.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, their secrets are masked; ``n_chars`` follows the text."""
    return secretscan.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the window they are packed in."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Models, tilings and packings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

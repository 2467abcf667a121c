"""The corpus pipeline: quality rules, exact dedup, near duplicates, mixing, packing.

Each stage takes all that the one before kept, is written to the shared folder as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import exact_dedup, mixing, ngram_jaccard, packing, robust_rules
from sedimenta.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that are no outliers of their language and source."""
    return robust_rules.kept(spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample by target weights of the sources."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of one context each."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Covariance estimates, drawing and packing aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

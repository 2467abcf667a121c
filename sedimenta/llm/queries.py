"""Registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, chat_format, exact_dedup, mixing, ngram_jaccard, packing, quality_classifier, robust_rules, substring_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, operator: Callable[[DataFrame], DataFrame], oracle: str | None = None, of: str = "documents") -> None:
    """Registers ``operator`` on the whole table ``of``."""
    QUERIES[name] = lambda spark, sf_dir: operator(table(spark, sf_dir, of))
    if oracle is not None:
        ORACLES[name] = oracle


query("op1_chat_formatting", lambda c: chat_format.rendered(chat_format.event_log(c)), chat_format.ORACLE, "conversations")
query("op2_substring_dedup", substring_dedup.repeated_spans, substring_dedup.oracle())
query("op3_lm_scoring", brown_lm.perplexities)
QUERIES["op4_quality_classifier"] = lambda spark, sf_dir: quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
query("op5_best_fit_packing", packing.packed)
query("op6_mixing", mixing.mixed)
query("op7_ngram_jaccard_join", ngram_jaccard.classes, ngram_jaccard.oracle())
query("op8_exact_dedup", exact_dedup.copies, exact_dedup.ORACLE)
query("op9_quality_rules", robust_rules.judged)
query("op10_warc", warc.round_trip, warc.ORACLE, "pages")

"""Summaries of shards to one, and positive against negative cohorts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import direction

#: What adds up over shards; everything else (thresholds, sizes, shares) doesn't.
ADDITIVE = r"(_docs|_count|_counts|_paras|_tokens|^total_.*|^docs)$"


def merged(shards: DataFrame) -> DataFrame:
    """``shards(shard, metric, value)`` in long form: sums of what adds up, by metric."""
    return shards.where(F.col("metric").rlike(ADDITIVE)).groupBy("metric").agg(F.sum("value").alias("value"), F.count("*").alias("n_shards"))


def long_form(df: DataFrame, *keys: str) -> DataFrame:
    values = [c for c in df.columns if c not in keys]
    return df.unpivot(list(keys), values, "metric", "value")


def control_compare(positive: DataFrame, negative: DataFrame, expected: DataFrame) -> DataFrame:
    """``(dim, metric, value)`` of two cohorts and ``expected(dim, metric, higher_is_better)`` to verdicts."""
    p, n = positive.select("dim", "metric", F.col("value").alias("positive")), negative.select("dim", "metric", F.col("value").alias("negative"))
    df = expected.join(p, ["dim", "metric"], "left").join(n, ["dim", "metric"], "left")
    return df.select("dim", "metric", "positive", "negative", direction(F.col("positive"), F.col("negative"), F.col("higher_is_better")).alias("verdict"))


def markdown(verdicts: DataFrame) -> str:
    rows = verdicts.orderBy("dim", "metric").collect()  # a report of a few rows
    return "\n".join(["| dim | metric | positive | negative | verdict |", "|-|-|-|-|-|", *(f"| {r.dim} | {r.metric} | {r.positive} | {r.negative} | {r.verdict} |" for r in rows)])


@dataclass(frozen=True)
class Merger:
    """How a stage's shard summaries make one: what adds up, and which shares are taken anew from the sums."""

    sums: tuple[str, ...]
    shares: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Metrics whose values are maps: numbers by key, added up by key.
    counters: tuple[str, ...] = ()
    #: Maps of which each key's value has a share of the map's own total (name of the value, name of the share).
    parts: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Settings that are the same in all shards: the first shard's.
    first: tuple[str, ...] = ()


_PCT = lambda total, **kinds: {f"{k}_pct": (v, total) for k, v in kinds.items()}
_TOKENS = {c: ("tokens", "pct_tokens") for c in ("domain_distribution", "language_distribution", "source_distribution")}
MERGERS = {
    "contamination_cascade": Merger(("total_docs", "cross_lingual_docs", "l1_red_count", "l2_red_count", "l2_green_count"), _PCT("total_docs", cross_lingual="cross_lingual_docs"), ("cost_breakdown", "per_benchmark_red_hits", "verdict_distribution")),
    "contamination_exact": Merger(("total_docs", "contaminated_docs", "para_contaminated_docs"), _PCT("total_docs", contaminated="contaminated_docs", para_contaminated="para_contaminated_docs"), ("per_benchmark_hits",)),
    "exact_dedup": Merger(("total_docs", "exact_dup_docs", "unique_doc_hashes", "para_dup_docs", "unique_para_hashes"), _PCT("total_docs", exact_dup="exact_dup_docs", para_dup="para_dup_docs")),
    "extraction": Merger(("total_docs", "html_residue_docs", "boilerplate_docs", "mojibake_docs", "short_stub_docs", "low_quality_docs", "markdown_docs", "url_docs"), _PCT("total_docs", html_residue="html_residue_docs", boilerplate="boilerplate_docs", mojibake="mojibake_docs", short_stub="short_stub_docs", low_quality="low_quality_docs", markdown="markdown_docs", url="url_docs"), ("top_phrases",)),
    "langid": Merger(("total_docs", "low_confidence_docs", "lang_mismatch_docs"), _PCT("total_docs", low_confidence="low_confidence_docs", lang_mismatch="lang_mismatch_docs"), ("language_distribution",)),
    "ngram_dedup": Merger(("total_docs", "contaminated_docs", "total_paras", "contaminated_paras"), {**_PCT("total_docs", contaminated="contaminated_docs"), **_PCT("total_paras", contaminated_para="contaminated_paras")}, first=("ngram_size", "overlap_threshold")),
    "pii": Merger(("total_docs_scanned", "docs_with_pii"), _PCT("total_docs_scanned", hit="docs_with_pii"), ("entity_type_distribution",), first=("score_threshold",)),
    "quality": Merger(("total_docs",), {}, ("filter_fail_counts", "filter_fail_reasons")),
    "secrets": Merger(("total_docs_scanned", "docs_with_secrets"), _PCT("total_docs_scanned", hit="docs_with_secrets"), ("rule_distribution",)),
    "stats": Merger(("total_docs",), {}, ("timestamp", *_TOKENS), {"length_buckets": ("count", "pct"), **_TOKENS}),
    "tokenize": Merger(("total_docs", "high_unk_docs", "high_fertility_docs", "total_tokens", "total_chars", "total_unk"), {"unk_rate": ("total_unk", "total_tokens"), "fertility": ("total_tokens", "total_chars")}, ("per_language",)),
}


def merged_stage(shards: DataFrame, stage: str) -> DataFrame:
    """``metric, key, value`` of a stage over all its shards, ``shards(shard, metric, key, value)`` (``reader.summaries``).

    Sums are taken shard-wise first; shares are taken anew from the sums (6 digits, 0 of
    nothing); the number of shards is ``aggregated_from``.  What a stage's merger doesn't
    name isn't merged: shares and percentiles of shards don't add up.
    """
    m = MERGERS[stage]
    plain = shards.where(F.col("key").isNull() & F.col("metric").isin(*m.sums)).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    keyed = shards.where(F.col("key").isNotNull() & F.col("metric").isin(*m.counters, *m.parts)).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    for metric, (value, share) in m.parts.items():  # shares of the shards give way to those of the sums
        keyed = keyed.where(~((F.col("metric") == metric) & F.col("key").endswith(f".{share}")))
    out = plain.unionByName(keyed)
    for name, (num, den) in m.shares.items():
        n, d = (F.coalesce(F.sum(F.when(F.col("metric") == x, F.col("value"))), F.lit(0.0)) for x in (num, den))
        out = out.unionByName(plain.agg(F.when(d > 0, F.round(n / d, 6)).otherwise(0.0).alias("value")).select(F.lit(name).alias("metric"), F.lit(None).cast("string").alias("key"), "value"))
    for metric, (value, share) in m.parts.items():
        own = keyed.where((F.col("metric") == metric) & F.col("key").endswith(f".{value}"))
        total = own.agg(F.sum("value").alias("t"))
        out = out.unionByName(own.crossJoin(F.broadcast(total)).select("metric", F.concat(F.substring("key", F.lit(1), F.length("key") - len(value)), F.lit(share)).alias("key"), F.when(F.col("t") > 0, F.round(F.col("value") / F.col("t"), 6)).otherwise(0.0).alias("value")))  # one row
    if m.first:
        out = out.unionByName(shards.where(F.col("key").isNull() & F.col("metric").isin(*m.first)).groupBy("metric", "key").agg(F.min_by("value", "shard").alias("value")))
    many = shards.agg(F.count_distinct("shard").cast("double").alias("value")).select(F.lit("aggregated_from").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    return out.unionByName(many)


def percentiles(per_doc: DataFrame, *columns: str) -> DataFrame:
    """``metric, count, total, mean, min, max, p25 .. p99`` of score columns, exact, from per-document rows of all shards."""
    rows = per_doc.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").where("v IS NOT NULL")
    qs = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    g = rows.groupBy("metric").agg(F.count("*").alias("count"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 2).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.array(*(F.lit(q) for q in qs))).alias("p"))
    return g.select("metric", "count", "total", "mean", "min", "max", *(F.round(F.col("p")[i], 2).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)))


def united_labels(*tables: DataFrame, id_col: str = "doc_id", column: str = "entities") -> DataFrame:
    """Comma lists of labels by document, united over tables."""
    rows = tables[0].select(id_col, column)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(id_col, column))
    each = rows.select(id_col, F.explode_outer(F.split(column, ",")).alias("x"))
    return each.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set(F.nullif("x", F.lit("")))), ",").alias(column))

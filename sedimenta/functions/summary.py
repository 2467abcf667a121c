"""Aggregates that the summaries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def share(count: Column, total: Column, digits: int = 4) -> Column:
    """Rounded ratio; 0 of nothing."""
    return F.when(total > 0, F.round(count / total, digits)).otherwise(0.0)


def flagged(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def distribution(df: DataFrame, key: Column, name: str, top: int | None = None) -> DataFrame:
    """``name, docs``, most frequent first, ties by name; the first ``top`` where a report asks for them."""
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("docs"))
    return out if top is None else out.orderBy(F.desc("docs"), name).limit(top)


def group_table(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``name, docs, tokens, pct_tokens`` of a per-document table with ``token_count``."""
    g = df.groupBy(key.alias(name)).agg(F.count("*").alias("docs"), F.sum("token_count").cast("long").alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy())  # over one row a group
    return g.select(name, "docs", "tokens", share(F.col("tokens"), total).alias("pct_tokens"))


def spread(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """One row: count, mean, population deviation, extremes and exact percentiles with linear interpolation."""
    p = F.percentile(column, F.array(*(F.lit(x) for x in (0.05, 0.5, 0.95, 0.99))))
    one = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), p.alias("p"))
    r = lambda c: F.round(c, digits)
    return one.select("n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", "max", *(r(F.col("p")[i]).alias(n) for i, n in enumerate(("p5", "p50", "p95", "p99"))))

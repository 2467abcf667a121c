"""Comparison statistics between recipes, proxies and targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def recipe_pairs(scores: DataFrame, *values: str) -> DataFrame:
    """``left, right`` and the difference ``d_<value>`` of each value, over all pairs of ``scores(recipe, ...)``."""
    a = scores.select(F.col("recipe").alias("left"), *(F.col(v).alias(f"a_{v}") for v in values))
    b = scores.select(F.col("recipe").alias("right"), *(F.col(v).alias(f"b_{v}") for v in values))
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", *((F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"d_{v}") for v in values))


def pairwise_agreement(scores: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """``scores(recipe, proxy, target)``: how often the proxy orders pairs as the target does; target ties don't count."""
    p = recipe_pairs(scores.where("proxy IS NOT NULL AND target IS NOT NULL"), "proxy", "target").where(F.abs("d_target") > min_gap)
    agrees, tie = F.col("d_proxy") * F.col("d_target") > 0, F.col("d_proxy") == 0
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = p.agg(F.count("*").alias("pair_count"), n(agrees).alias("correct"), n(~agrees & ~tie).alias("incorrect"), n(tie).alias("proxy_ties"))
    return g.withColumn("accuracy", F.when(F.col("pair_count") > 0, F.round(F.col("correct") / F.col("pair_count"), 6)))


def seed_stability(scores: DataFrame, target: DataFrame) -> DataFrame:
    """``scores(seed, recipe, proxy)``, ``target(recipe, target)``: decided only if all seeds agree and none ties."""
    n_seeds = scores.agg(F.countDistinct("seed").alias("n_seeds"))
    full = scores.groupBy("recipe").agg(F.countDistinct("seed").alias("n")).crossJoin(F.broadcast(n_seeds)).where("n = n_seeds").select("recipe")  # one row
    t = target.join(full, "recipe", "left_semi")
    d = recipe_pairs(t, "target").where("d_target <> 0")
    a, b = scores.select("seed", F.col("recipe").alias("left"), F.col("proxy").alias("pl")), scores.select(F.col("seed").alias("s2"), F.col("recipe").alias("right"), F.col("proxy").alias("pr"))
    m = d.join(a, "left").join(b, "right").where("seed = s2").groupBy("left", "right", "d_target").agg(F.min(F.signum(F.col("pl") - F.col("pr"))).alias("lo"), F.max(F.signum(F.col("pl") - F.col("pr"))).alias("hi"))
    sure = (F.col("lo") == F.col("hi")) & (F.col("lo") != 0)
    right_ = F.col("lo") == F.signum("d_target")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = m.agg(F.count("*").alias("pair_count"), n(sure & right_).alias("correct"), n(sure & ~right_).alias("incorrect"), n(~sure).alias("abstained"))
    done = F.col("correct") + F.col("incorrect")
    return g.select("*", F.when(F.col("pair_count") > 0, F.round(done / F.col("pair_count"), 6)).alias("coverage"), F.when(done > 0, F.round(F.col("correct") / done, 6)).alias("conditional_accuracy"))


def kendall_tau_b(scores: DataFrame) -> DataFrame:
    """``scores(recipe, proxy, target)``; pairs tied on both sides don't count, null where nothing is left."""
    p = recipe_pairs(scores.where("proxy IS NOT NULL AND target IS NOT NULL"), "proxy", "target").select(F.signum("d_proxy").alias("x"), F.signum("d_target").alias("y"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    x, y = F.col("x"), F.col("y")
    g = p.agg(n(x * y > 0).alias("concordant"), n(x * y < 0).alias("discordant"), n((x == 0) & (y != 0)).alias("left_ties"), n((x != 0) & (y == 0)).alias("right_ties"))
    c, d = F.col("concordant"), F.col("discordant")
    den = F.sqrt((c + d + F.col("left_ties")) * (c + d + F.col("right_ties")))
    return g.withColumn("tau_b", F.when(den > 0, F.round((c - d) / den, 6)))


def benjamini_hochberg(p: DataFrame) -> DataFrame:
    """``p(name, p_value)`` with the adjusted ``q_value``: a running minimum from the largest p-value down.

    The family of tests is one window; it is as large as the list of comparisons.
    """
    w = W.partitionBy(F.lit(0)).orderBy("p_value", "name")
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    r = p.withColumn("raw", F.col("p_value") * n / F.row_number().over(w))
    back = W.partitionBy(F.lit(0)).orderBy(F.desc("p_value"), F.desc("name")).rowsBetween(W.unboundedPreceding, 0)
    return r.select("name", "p_value", F.round(F.least(F.lit(1.0), F.min("raw").over(back)), 6).alias("q_value"))


def choice_metrics(rows: DataFrame) -> DataFrame:
    """``rows(example_id, grp, loglik, tokens, chars, gold)`` with arrays by choice: accuracy with shared ties, probabilities, margin."""
    per = F.zip_with("loglik", "chars", lambda l, c: l / c)
    d = rows.select("example_id", "grp", "loglik", "tokens", "gold", per.alias("p"))
    best = F.array_max("p")
    g = F.try_element_at("p", F.col("gold") + 1)
    tied = F.size(F.filter("p", lambda x: F.abs(x - best) <= 1e-12))
    mass = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    wrong = F.array_max(F.transform("p", lambda x, i: F.when(i != F.col("gold"), x)))
    return d.select("example_id", "grp", F.round(F.when(g >= best - 1e-12, 1.0).otherwise(0.0) / tied, 6).alias("accuracy"), F.round(F.exp(g), 6).alias("correct_prob_per_char"), F.round(F.exp(g - best) / mass, 6).alias("normalized_choice_probability"), F.round(g - wrong, 6).alias("margin"), F.round(F.try_element_at("loglik", F.col("gold") + 1) / F.try_element_at("tokens", F.col("gold") + 1), 6).alias("logprob_per_token"), F.when(tied > 1, 1.0).otherwise(0.0).alias("choice_tie"))


def micro_macro(metrics: DataFrame, metric: str = "accuracy", group: str = "grp") -> DataFrame:
    """Mean over rows and mean over group means."""
    g = metrics.groupBy(group).agg(F.sum(metric).alias("s"), F.count(metric).alias("n"))
    return g.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"), F.count("*").alias("n_groups"))


def _resample(samples: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("example_id")["diff"].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = np.concatenate([x[rng.integers(0, len(x), (min(256, samples - k), len(x)))].mean(1) for k in range(0, samples, 256)])
        lo, hi = np.quantile(means, [0.025, 0.975])
        seen = abs(x.mean())
        rng = np.random.default_rng(seed)
        extreme = sum(int((np.abs(((rng.integers(0, 2, (min(256, samples - k), len(x))) * 2 - 1) * x).mean(1)) >= seen - 1e-15).sum()) for k in range(0, samples, 256))
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "mean": [x.mean()], "low": [lo], "high": [hi], "p_value": [1.0 if seen == 0 else (extreme + 1) / (samples + 1)]})

    return run


def paired_intervals(diffs: DataFrame, samples: int = 1000, seed: int = 6198) -> DataFrame:
    """``diffs(name, example_id, diff)``: mean, bootstrap interval and sign-flip p-value by name."""
    return diffs.groupBy("name").applyInPandas(_resample(samples, seed), "name string, mean double, low double, high double, p_value double")


def direction(positive: Column, negative: Column, higher_is_better: Column, tie: float = 0.05) -> Column:
    """PASS, FAIL, TIE (within ``tie`` of the larger), ``~`` without an expectation, ERR without a value."""
    rel = F.abs(positive - negative) / F.greatest(F.abs(positive), F.abs(negative), F.lit(1e-12))
    good = F.when(higher_is_better, positive > negative).otherwise(positive < negative)
    return F.when(higher_is_better.isNull(), "~").when(positive.isNull() | negative.isNull(), "ERR").when(rel < tie, "TIE").when(good, "PASS").otherwise("FAIL")


def paired_units(left: DataFrame, right: DataFrame, metric: str = "accuracy", by_group: bool = False) -> DataFrame:
    """``example_id, diff`` of two runs' predictions ``(example_id, grp, <metric>)``; by group the mean of each group's.

    Runs that don't have the same examples, or put one into different groups, are an error.
    """
    a = left.select("example_id", F.col("grp").alias("ga"), F.col(metric).cast("double").alias("a"))
    b = right.select(F.col("example_id").alias("e2"), F.col("grp").alias("gb"), F.col(metric).cast("double").alias("b"))
    both = a.join(b, F.col("example_id") == F.col("e2"), "full")
    wrong = F.when(F.col("example_id").isNull() | F.col("e2").isNull(), F.raise_error(F.lit("paired runs do not have the same examples"))).when(~F.col("ga").eqNullSafe(F.col("gb")), F.raise_error(F.concat(F.lit("another group for "), F.col("example_id").cast("string"))))
    d = both.select("example_id", "ga", F.coalesce(wrong.cast("double"), F.col("a") - F.col("b")).alias("diff"))
    return d.groupBy(F.col("ga").alias("example_id")).agg(F.avg("diff").alias("diff")) if by_group else d.select("example_id", "diff")


def target_resolution(runs: DataFrame, samples: int = 1000, seed: int = 6198, q_most: float = 0.05) -> DataFrame:
    """``runs(recipe, example_id, grp, accuracy)``: which pairs of recipes the target tells apart.

    ``left, right, delta, low, high, p_value, q_value, decisive, fdr_decisive, direction``.
    """
    a = runs.select(F.col("recipe").alias("left"), "example_id", F.col("accuracy").cast("double").alias("a"))
    b = runs.select(F.col("recipe").alias("right"), "example_id", F.col("accuracy").cast("double").alias("b"))
    diffs = a.join(b, "example_id").where("left < right").select(F.to_json(F.array("left", "right")).alias("name"), "example_id", (F.col("a") - F.col("b")).alias("diff"))
    ci = paired_intervals(diffs, samples, seed)
    q = benjamini_hochberg(ci.select("name", "p_value")).select(F.col("name").alias("n2"), "q_value")
    out = ci.join(q, F.col("name") == F.col("n2"))
    pair = F.from_json("name", "array<string>")
    sure = (F.col("low") > 0) | (F.col("high") < 0)
    return out.select(pair[0].alias("left"), pair[1].alias("right"), F.round("mean", 6).alias("delta"), "low", "high", "p_value", "q_value", sure.alias("decisive"), (sure & (F.col("q_value") <= q_most)).alias("fdr_decisive"), F.when(sure, F.signum("mean").cast("int")).otherwise(0).alias("direction"))


def target_usable(resolution: DataFrame, scores: DataFrame, chance: float, least_pairs: int = 20, least_lift: float = 0.05) -> DataFrame:
    """One row: decisive pairs, the mean lift over ``chance`` (as a share of what is possible), and whether both suffice.  ``scores(recipe, target)``."""
    n = resolution.agg(F.count("*").alias("pair_count"), F.count_if("decisive").alias("decisive_pairs"), F.count_if("fdr_decisive").alias("fdr_decisive_pairs"))
    lift = scores.agg(F.round((F.avg("target") - chance) / (1 - chance), 6).alias("normalized_lift"))
    return n.crossJoin(lift).withColumn("usable", (F.col("decisive_pairs") >= least_pairs) & (F.col("normalized_lift") >= least_lift))  # one row each


def decision_matrix(resolution: DataFrame, proxies: DataFrame) -> DataFrame:
    """``proxies(scale, recipe, proxy)`` against the target's decisive pairs: accuracy by scale."""
    d = resolution.where("decisive").select("left", "right", "direction")
    a, b = proxies.select("scale", F.col("recipe").alias("left"), F.col("proxy").alias("pl")), proxies.select(F.col("scale").alias("s2"), F.col("recipe").alias("right"), F.col("proxy").alias("pr"))
    m = d.join(a, "left").join(b, "right").where("scale = s2").withColumn("side", F.signum(F.col("pl") - F.col("pr")))
    return m.groupBy("scale").agg(F.count("*").alias("pair_count"), F.count_if(F.col("side") == F.col("direction")).alias("correct"), F.count_if(F.col("side") == 0).alias("ties")).withColumn("accuracy", F.round(F.col("correct") / F.col("pair_count"), 6))

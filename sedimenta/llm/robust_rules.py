"""Quality rules as robust multivariate outliers (operator 9).

Each document is a vector of transformed statistics.  For every language and source
a minimum-covariance-determinant estimate gives the centre and the scatter of the
bulk of its documents, however many bad ones there are among them (up to a
quarter), and documents far from it by Mahalanobis distance are rejected.  A small
group's centre and scatter are drawn towards those of its language, and these towards
those of the whole corpus, each by the weight of ``PSEUDO`` documents; so every
document that has words is judged, whatever the size of its group.

Statistics are rates of counts.  A short text's rates say little, so each rate is
shrunk towards that of its language by a fixed number of pseudo-counts, then
transformed (arcsine of the root for shares, logarithm for means).  ``FLOOR`` is
added to the variance of each, so that a statistic that hardly varies in a group
doesn't reject what differs from it by a trifle.

The estimate starts from medians and absolute deviations and goes on by
concentration steps, until they change nothing: distances of all documents, the
quantile of them by group, the moments of those below it.  A step is two aggregations
over a narrow table; nothing is sampled and nothing but group moments is gathered.
Quantiles are ``percentile_approx`` of accuracy 10,000: exact in groups up to about
that size, else off by at most 1 in 10,000 of the group's ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import kernels as K
from .common import fits, fresh, key_of, small, streamed, written

#: name, count, of which total, pseudo-counts; the first is a mean, the others are shares.
RATES = (
    ("word_length", "word_bytes", "n_words", 50),
    ("punctuation", "n_punct", "n_bytes", 300),
    ("digits", "n_digit", "n_bytes", 300),
    ("capitals", "n_upper", "n_bytes", 300),
    ("non_ascii", "n_wide", "n_bytes", 300),
    ("stutter", "n_stutter", "n_words", 50),
    ("line_breaks", "n_breaks", "n_words", 50),
    ("repeated_lines", "n_repeated", "n_lines", 10),
)
COUNTS = ("n_bytes", "n_words", "word_bytes", "n_punct", "n_digit", "n_upper", "n_wide", "n_stutter", "n_breaks", "n_lines", "n_repeated")
D = len(RATES)
TRUSTED = 0.75
FLOOR = 0.05
TAIL = 1e-8
#: Documents that a language weighs in the estimate of one of its sources, and the corpus in that of a language.
PSEUDO = 100
#: More steps than any estimate takes: each lowers a determinant, and they end where none does.
STEPS = 100

_CLASS = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _c = chr(_b)
    _CLASS[_b] = 2 if _c.isdigit() else 3 if _c.isupper() else 0 if _c.islower() else 1
_CLASS[128:] = 4
_CLASS[10] = 5


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts in ``COUNTS`` of each document of a buffer."""
    n = len(offsets) - 1
    starts, ends, firsts = K.spans(data, offsets)
    h = K.hash_spans(data, starts, ends)
    size = np.diff(firsts)
    out = {"n_bytes": np.diff(offsets), "n_words": size}
    sums = np.r_[0, np.cumsum(ends - starts)]
    out["word_bytes"] = sums[firsts[1:]] - sums[firsts[:-1]]
    kind = _CLASS[data]
    for name, k in (("n_punct", 1), ("n_digit", 2), ("n_upper", 3), ("n_wide", 4), ("n_breaks", 5)):
        at = np.flatnonzero(kind == k)
        out[name] = np.diff(np.searchsorted(at, offsets))
    doc = np.repeat(np.arange(n), size)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, np.int64)
    out["n_stutter"] = np.bincount(doc[same], minlength=n)
    # lines: runs of words between line feeds, by the sum of their words' hashes in order
    breaks = np.flatnonzero(kind == 5)
    cuts = np.unique(np.r_[offsets[:-1], breaks]) if n else np.zeros(0, np.int64)
    first = np.searchsorted(starts, cuts)
    last = np.r_[first[1:], len(starts)]
    has = last > first
    first, last = first[has], last[has]
    up, down = K.powers(np.uint64(0x9FB21C651E98DF25), len(h) + 1)
    run = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)])]
    line = K.mix((run[last] - run[first]) * down[first])
    of = doc[first] if len(first) else np.zeros(0, np.int64)
    _, kept = K.distinct(line, of)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_repeated"] = out["n_lines"] - np.bincount(kept, minlength=n)
    return out


def _stats(batches):
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        parts = []
        for lo, hi in K.pieces(offsets):
            o = offsets[lo : hi + 1]
            parts.append(counts(data[o[0] : o[-1]], o - o[0]))
        cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
        keys = ["id", "tag", "lang", "source"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], [*keys, *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every row: (id, tag, lang, source, counts); ``tag`` tells the texts of one id apart.  Ids keep their type."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    return streamed(rows, _stats, f"id {rows.schema['id'].dataType.simpleString()}, tag long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def chi2(p_tail: float, d: int) -> float:
    """Quantile of the chi-squared distribution, by bisection on its tail for even ``d``."""

    def tail(x: float) -> float:
        term = total = math.exp(-x / 2)
        for k in range(1, d // 2):
            term *= x / 2 / k
            total += term
        return total

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > p_tail else (lo, mid)
    return lo


X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _vectors(stats: DataFrame) -> DataFrame:
    """(id, tag, lang, source, n_words, unit, in_lang, x0..): transformed statistics, and the names of the groups that judge the document."""
    df = stats.where("n_words > 0")
    needed = sorted({c for _, a, b, _ in RATES for c in (a, b)})
    rates = df.groupBy("lang").agg(*(F.sum(c).cast("double").alias(f"t_{c}") for c in needed))
    rates = written(rates.withColumnRenamed("lang", "l2"), "rates")
    df = df.join(small(rates), F.col("lang").eqNullSafe(F.col("l2"))).drop("l2")
    xs = []
    for k, (_, a, b, pseudo) in enumerate(RATES):
        prior = F.col(f"t_{a}") / F.greatest(F.col(f"t_{b}"), F.lit(1.0))
        rate = (F.col(a) + pseudo * prior) / (F.col(b) + pseudo)
        xs.append((F.log(F.greatest(rate, F.lit(1e-6))) if k == 0 else 2 * F.asin(F.sqrt(F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))))).alias(X[k]))
    return df.select("id", "tag", "lang", "source", "n_words", F.to_json(F.array("lang", "source")).alias("unit"), F.to_json(F.array("lang")).alias("in_lang"), *xs)


def _invert(floor: float):
    def run(batches):
        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                r = r._asdict()
                n = max(r["n"], 1.0)
                m = np.array([r[f"s{i}"] for i in range(D)]) / n
                c = np.zeros((D, D))
                for i, j in PAIRS:
                    c[i, j] = c[j, i] = r[f"q{i}_{j}"] / n - m[i] * m[j]
                c = r["scale"] * c + np.eye(D) * floor**2
                inv = np.linalg.inv(c)
                rows.append([r["unit"], r["n"], *m, *_packed(inv), float(np.linalg.slogdet(c)[1])])
            yield pd.DataFrame(rows, columns=["u2", "weight", *MS, *PS, "logdet"])

    return run


MS, PS = [f"m{i}" for i in range(D)], [f"p{i}_{j}" for i, j in PAIRS]
_EST = ", ".join(["u2 string", "weight double", *(f"{c} double" for c in (*MS, *PS)), "logdet double"])


def _packed(inverse: np.ndarray) -> list[float]:
    """The upper triangle; places off the diagonal stand for both."""
    return [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS]


def _scatter(p: list[float]) -> np.ndarray:
    inverse = np.zeros((D, D))
    for (i, j), x in zip(PAIRS, p):
        inverse[i, j] = inverse[j, i] = x if i == j else x / 2
    return np.linalg.inv(inverse)


def _blend(pseudo: float):
    """Estimates of a group, its language and the corpus (columns by prefix) to the group's, drawn towards the others."""

    def run(batches):
        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                r = r._asdict()
                m = c = None
                for level in "abc":
                    own_m, own_c, n = np.array([r[f"{level}_{x}"] for x in MS]), _scatter([r[f"{level}_{x}"] for x in PS]), r[f"{level}_weight"]
                    w = 1.0 if m is None else n / (n + pseudo)
                    m, c = (own_m, own_c) if m is None else (w * own_m + (1 - w) * m, w * own_c + (1 - w) * c)
                rows.append([r["u2"], r["c_weight"], *m, *_packed(np.linalg.inv(c)), float(np.linalg.slogdet(c)[1])])
            yield pd.DataFrame(rows, columns=["u2", "weight", *MS, *PS, "logdet"])

    return run


def blended(vectors: DataFrame, est: DataFrame, pseudo: float) -> DataFrame:
    """Estimates by ``unit``, small ones drawn towards their language's and the corpus's."""
    named = lambda level: est.select(*(F.col(c).alias(f"{level}_{c}") for c in est.columns))
    units = written(vectors.select("unit", "in_lang").distinct(), "groups")
    rows = units.join(small(named("c")), F.col("unit") == F.col("c_u2")).join(small(named("b")), F.col("in_lang") == F.col("b_u2")).join(small(named("a").where("a_u2 = '[]'")), F.lit(True))  # one row
    return written(rows.withColumnRenamed("unit", "u2").mapInPandas(_blend(pseudo), _EST), "blended")


def _moments(df: DataFrame) -> DataFrame:
    """Sums by group of what ``_invert`` needs, around 0 (the statistics are of order 1)."""
    return df.groupBy("unit").agg(F.count("*").cast("double").alias("n"), *(F.expr(f"sum({x}) AS s{i}") for i, x in enumerate(X)), *(F.expr(f"sum({X[i]} * {X[j]}) AS q{i}_{j}") for i, j in PAIRS))


def _distance(df: DataFrame, est: DataFrame) -> DataFrame:
    """``df`` with the squared distance ``d2`` from its unit's centre."""
    d2 = F.expr(" + ".join(f"p{i}_{j} * ({X[i]} - m{i}) * ({X[j]} - m{j})" for i, j in PAIRS))
    return df.join(est, F.col("unit") == F.col("u2")).select(*df.columns, d2.alias("d2"))


def _quantiles(far: DataFrame, trusted: float) -> DataFrame:
    q = far.groupBy("unit").agg(F.percentile_approx("d2", F.array(F.lit(trusted), F.lit(0.5)), 10000).alias("q"))
    return q.select(F.col("unit").alias("u3"), F.col("q")[0].alias("at_trusted"), F.col("q")[1].alias("at_half"))


def _fit(near: DataFrame, share: float, floor: float) -> DataFrame:
    """Centre and scatter of the rows given, the central ``share`` of their units."""
    moments = _moments(near).withColumn("scale", F.lit(1.0 / central_variance(share)))
    return written(moments.mapInPandas(_invert(floor), _EST), "estimate")


def central_variance(share: float) -> float:
    """Variance along an axis of the central ``share`` of a standard Gaussian in ``D`` dimensions."""
    q = chi2(1 - share, D)
    term = total = math.exp(-q / 2)
    for k in range(1, D // 2 + 1):
        term *= q / 2 / k
        total += term
    return (1 - total) / share


def estimates(vectors: DataFrame, trusted: float = TRUSTED, floor: float = FLOOR, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant centre and inverse scatter by ``unit``, reweighted."""
    mid = written(vectors.groupBy(F.col("unit").alias("u3")).agg(*(F.percentile_approx(x, 0.5, 10000).alias(f"c{i}") for i, x in enumerate(X))), "medians")
    apart = vectors.join(small(mid), F.col("unit") == F.col("u3"))
    apart = apart.groupBy("unit").agg(*(F.first(f"c{i}").alias(f"s{i}") for i in range(D)), *(F.percentile_approx(F.abs(F.col(X[i]) - F.col(f"c{i}")), 0.5, 10000).alias(f"a{i}") for i in range(D)))
    start = apart.select("unit", F.lit(1.0).alias("n"), F.lit(1.0).alias("scale"), *(f"s{i}" for i in range(D)), *((F.col(f"s{i}") * F.col(f"s{j}") + (F.pow(1.4826 * F.col(f"a{i}"), F.lit(2)) if i == j else F.lit(0.0))).alias(f"q{i}_{j}") for i, j in PAIRS))
    est = written(start.mapInPandas(_invert(floor), _EST), "estimate")
    # every later table by unit has these units, and no more columns: one check holds for all
    sent = F.broadcast if fits(est) else lambda df: df
    for _ in range(steps):
        far = _distance(vectors, sent(est))
        near = far.join(sent(_quantiles(far, trusted)), F.col("unit") == F.col("u3")).where("d2 <= at_trusted")
        new = _fit(near, trusted, floor)
        before = est.select(F.col("u2").alias("u4"), F.col("logdet").alias("before"))
        moved = new.join(sent(before), F.col("u2") == F.col("u4")).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        est = new
        if moved is None or moved < 1e-3:
            break
    far = _distance(vectors, sent(est))
    consistent = F.greatest(F.col("at_half") / chi2(0.5, D), F.lit(1.0)) * chi2(0.025, D)
    return _fit(far.join(sent(_quantiles(far, trusted)), F.col("unit") == F.col("u3")).where(F.col("d2") <= consistent), 0.975, floor)


def _judged(docs: DataFrame, tail: float, pseudo: float, trusted: float, floor: float, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    stats = written(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    vectors = written(_vectors(stats), "vectors")
    levels = vectors.select(F.explode(F.array("unit", "in_lang", F.lit("[]"))).alias("unit"), *X)
    est = blended(vectors, estimates(levels, trusted, floor), pseudo)
    far = _distance(vectors, small(est)).withColumn("distance", F.sqrt(F.greatest("d2", F.lit(0.0))))
    limit = math.sqrt(chi2(tail, D))
    columns = ["id", "tag", "lang", "source", "n_words", "distance", "keep"]
    found = far.withColumn("keep", F.col("distance") <= limit)
    empty = stats.where("n_words = 0").withColumn("distance", F.lit(None).cast("double")).withColumn("keep", F.lit(False))
    return found.select(*columns).unionByName(empty.select(*columns))


def judged(docs: DataFrame, tail: float = TAIL, pseudo: float = PSEUDO, trusted: float = TRUSTED, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every row, judged: ``doc_id, lang, source, n_words, distance, keep``.

    ``distance`` is the Mahalanobis distance from the robust centre of the row's
    language and source; rows beyond the quantile of the chi-squared distribution
    that leaves ``tail`` are rejected.  The estimate of a group of ``n`` documents
    weighs ``n / (n + pseudo)``, the rest is its language's, in which the corpus has
    its part in the same way.  Null languages and sources are groups of their own.
    Documents without words (null, empty, white space) have no statistics: distance
    null, rejected.  Rows without id, and equal rows, are judged like others.  Very long
    texts count whole.  An empty table gives an empty result.  Ids are of any type.
    """
    found = _judged(docs, tail, pseudo, trusted, floor, id_col, text_col, lang_col, source_col)
    return found.select(F.col("id").alias("doc_id"), "lang", "source", "n_words", F.round("distance", 3).alias("distance"), "keep")


def kept(docs: DataFrame, tail: float = TAIL, pseudo: float = PSEUDO, trusted: float = TRUSTED, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects, their columns as they are.

    A row goes if it is rejected under its language and source; rows without id stay.
    """
    i, t, la, so = fresh(docs, "id", "tag", "lang", "source")
    bad = _judged(docs, tail, pseudo, trusted, floor, id_col, text_col, lang_col, source_col).where("NOT keep AND id IS NOT NULL")
    bad = written(bad.select(key_of(bad, "id").alias(i), F.col("tag").alias(t), F.col("lang").alias(la), F.col("source").alias(so)).distinct(), "rejected")
    text = F.col(text_col).cast("string")
    match = (key_of(docs, id_col) == F.col(i)) & (F.xxhash64(text) == F.col(t)) & F.col(lang_col).cast("string").eqNullSafe(F.col(la)) & F.col(source_col).cast("string").eqNullSafe(F.col(so))
    return docs.join(small(bad), match, "left_anti")

"""Mixing sources to target weights by the cube method (operator 6).

Every source has a target share of the token budget; its documents get the
inclusion probability that reaches it.  The flight phase then moves the vector of
probabilities along the null space of the balancing constraints (number of
documents and number of tokens) until nearly all are 0 or 1, by a martingale, so
that each document keeps its probability and both totals stay as they were.  It
runs in blocks of each source, then over what the blocks of a source leave (two
documents each at most), then over what all sources leave.  Only the landing, of
two documents at most, gives up the constraints.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import fresh, give_back, key_of, named, small, written

ALPHA = 0.7
KEEP = 0.8
BLOCK_DOCS = 50_000
SEED = 42
_EPS = 1e-9


def token_estimate(text_col: str = "text") -> Column:
    """Tokens of a text, as a quarter of its bytes, rounded up; none for null."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text_col).cast("string")) / 4), F.lit(0)).cast("long")


def target_tokens(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Tokens by source: ``budget`` shared in proportion to ``weights``, no source beyond what it has.

    What a source can't give goes to the others, in proportion again.
    """
    tokens, weights = tokens.astype(float), np.where(tokens > 0, weights, 0).astype(float)
    out = np.zeros(len(tokens))
    budget = min(budget, float(tokens[weights > 0].sum()))
    open_ = weights > 0
    while open_.any() and budget > 0:
        share = np.where(open_, budget * weights / weights[open_].sum(), 0)
        full = open_ & (share >= tokens)
        if not full.any():
            return np.where(open_, share, out)
        out[full] = tokens[full]
        budget -= float(tokens[full].sum())
        open_ &= ~full
    return out


def _move(p: list[float], u: list[float], rng: random.Random) -> None:
    """One step of the martingale along ``u``, to where one of ``p`` is 0 or 1."""
    up = down = math.inf
    for x, d in zip(p, u):
        if d > 0:
            up, down = min(up, (1 - x) / d), min(down, x / d)
        elif d < 0:
            up, down = min(up, -x / d), min(down, (x - 1) / d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in enumerate(u):
        x = p[i] + step * d
        p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def flight(pi: np.ndarray, t: np.ndarray, seed: str, counts: bool = True, sizes: bool = True) -> np.ndarray:
    """Flight phase under the constraints of number (``counts``) and of tokens (``sizes``)."""
    rng = random.Random(seed)
    out = pi.astype(float).copy()
    todo = np.flatnonzero((out > _EPS) & (out < 1 - _EPS)).tolist()
    rng.shuffle(todo)
    hold: list[int] = []
    need = 1 + counts + sizes
    while True:
        while len(hold) < need and todo:
            hold.append(todo.pop())
        ts = [float(t[i]) for i in hold]
        if counts and sizes:
            same = next(((i, j) for i in range(len(ts)) for j in range(i) if ts[i] == ts[j]), None)
            if same:
                u = [0.0] * len(hold)
                u[same[0]], u[same[1]] = 1.0, -1.0
            elif len(hold) == 3:
                scale = max(ts)
                u = [(ts[2] - ts[1]) / scale, (ts[0] - ts[2]) / scale, (ts[1] - ts[0]) / scale]
            else:
                return out
        elif counts:
            if len(hold) < 2:
                return out
            u = [1.0, -1.0]
        else:
            if not hold:
                return out
            u = [1.0]
        p = [float(out[i]) for i in hold]
        _move(p, u, rng)
        for i, x in zip(hold, p):
            out[i] = x
        hold = [i for i, x in zip(hold, p) if 0.0 < x < 1.0]


def _flight(seed: int, level: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("nameless", "ascending")])
        pi = table.column("pi").to_numpy()
        key = f"{seed}:{level}:{table.column('source')[0].as_py() if level != 'all' else ''}:{table.column('block')[0].as_py()}"
        out = flight(pi, table.column("n_tokens").to_numpy(), key)
        if level == "all":  # the landing: first without the tokens, then without the number
            out = flight(out, table.column("n_tokens").to_numpy(), key + ":landing", sizes=False)
            out = flight(out, table.column("n_tokens").to_numpy(), key + ":last", counts=False, sizes=False)
        out = table.set_column(table.column_names.index("pi"), "pi", pa.array(out))
        give_back()
        return out

    return run


def _unit(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """What is drawn as one: the rows of an id; without id, those of one source and text (``nameless``, else 0)."""
    key = key_of(docs, id_col)
    content = F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return [F.coalesce(key, F.lit(0).cast("long")), F.when(key.isNull(), content).otherwise(F.lit(0).cast("long"))]


def _drawn(docs: DataFrame, weights: dict[str | None, float] | None, keep: float, alpha: float, seed: int, id_col: str, source_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    """(id, nameless, source, n_tokens, first_pi, drawn) of every document."""
    if not 0 <= keep <= 1:
        raise ValueError("keep must be between 0 and 1")
    ship(docs.sparkSession)
    n_tokens = token_estimate(text_col) if tokens is None else tokens.cast("long")
    key, nameless = _unit(docs, id_col, source_col, text_col)
    units = docs.select(key.alias("id"), nameless.alias("nameless"), F.col(source_col).cast("string").alias("source"), n_tokens.alias("n_tokens"))
    units = written(units.groupBy("id", "nameless").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")), "units")
    totals = written(units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "totals")
    found = totals.orderBy("source").toPandas()  # a row a source: the targets are shared out among them
    t = found["t"].to_numpy(dtype=float)
    names = [None if s is None or s != s else s for s in found["source"]]
    w = t**alpha if weights is None else np.array([float(weights.get(s, 0.0)) for s in names])
    target = target_tokens(t, w, keep * t.sum()) if len(t) else np.zeros(0)
    rows = [(s, float(min(1.0, a / b)) if b > 0 else 1.0, -(-int(n) // BLOCK_DOCS)) for s, a, b, n in zip(names, target, t, found["n"])]
    rates = docs.sparkSession.createDataFrame(rows, "of string, pi double, blocks int")
    units = units.join(small(rates), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("id", "nameless", F.lit(seed)), F.col("blocks")).cast("int"))
    schema = "id long, nameless long, source string, n_tokens long, first_pi double, pi double, block int"
    units = units.select("id", "nameless", "source", "n_tokens", F.col("pi").alias("first_pi"), "pi", "block")
    level0 = written(units.groupBy("source", "block").applyInArrow(_flight(seed, "block"), schema), "flight")
    part = "pi > 0 AND pi < 1"
    level1 = written(level0.where(part).withColumn("block", F.lit(-1)).groupBy("source", "block").applyInArrow(_flight(seed, "source"), schema), "flight")
    level2 = level1.where(part).withColumn("block", F.lit(-2)).groupBy("block").applyInArrow(_flight(seed, "all"), schema)
    done = level0.where(f"NOT ({part})").unionByName(level1.where(f"NOT ({part})")).unionByName(level2)
    return done.select("id", "nameless", "source", "n_tokens", "first_pi", (F.col("pi") == 1).alias("drawn"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, keep: float = KEEP, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """A balanced sample of documents: ``doc_id, source, n_tokens, inclusion_probability``.

    ``keep`` is the share of all tokens that the sample has.  ``weights`` are the
    target weights by source (none for a source that isn't named); by default the
    tokens of a source to the power ``alpha``, so that large sources count for less.
    A source never gives more than it has; the rest goes to the others.  The sample's
    number of documents and of tokens differ from the expected ones, in each source,
    by what the last two documents make, and so they do over all sources.

    Rows that share an id are one document, in the first of their sources, its tokens
    their sum; rows without id are one if they share source and text, and are drawn
    like others (``doc_id`` null).  A null source is a source of its own.  Documents
    without tokens (null or empty text) are drawn with the probability of their
    source.  An empty table gives an empty result.  Ids are of any type.
    """
    found = _drawn(docs, weights, keep, alpha, seed, id_col, source_col, text_col, tokens).where("drawn")
    found = found.select(F.when(F.col("nameless") == 0, F.col("id")).alias("doc_id"), "source", "n_tokens", F.col("first_pi").alias("inclusion_probability"))
    return named(found, docs, id_col, "doc_id")


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, keep: float = KEEP, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` draws, their columns as they are; all rows of a document go together."""
    out = _drawn(docs, weights, keep, alpha, seed, id_col, source_col, text_col, tokens).where("NOT drawn")
    i, n = fresh(docs, "id", "nameless")
    out = written(out.select(F.col("id").alias(i), F.col("nameless").alias(n)), "not-drawn")
    key, nameless = _unit(docs, id_col, source_col, text_col)
    return docs.join(small(out), (key == F.col(i)) & (nameless == F.col(n)), "left_anti")

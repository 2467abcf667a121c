"""Best-fit packing by a configuration linear program (operator 5).

Documents are cut into pieces of at most ``context`` tokens; all but the last of a
document are full.  What is left is packed: lengths are rounded up to multiples of
``grain`` and counted, so that the problem is a histogram whose size doesn't depend
on the number of documents.  The linear program over configurations (multisets of
lengths that fit into a bin) is solved by multiplicative weights: lengths that are
covered badly weigh more, and a knapsack by dynamic programming prices the best
configuration under these weights.  The weights, and their average, are dual
solutions: they give a lower bound, and the steps are made finer until the program's
value is within ``EPSILON`` of it.  Whole parts of the solution are taken as they
are; the few items that the fractions leave are packed by best fit.  Where best fit
alone needs fewer bins than that, its bins are taken.  The plan is then applied to the
pieces by their rank within their length, in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shards_for
from .mixing import token_estimate

CONTEXT = 2048
GRAIN = 8
#: Gap between the program's value and the lower bound at which it counts as solved.
EPSILON = 0.02
#: Share of a length's demand that a step covers at most: the coarsest, and the finest.
PART, FINEST = 1 / 4, 1 / 256


def knapsack(y: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes ``1..len(y)-1`` within ``capacity`` of the largest sum of ``y``."""
    used = np.flatnonzero(y > 0)
    value = y[used]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(used, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gains = value[: fits[c]] + best[c - used[: fits[c]]]
            k = int(gains.argmax())
            if gains[k] > best[c]:
                best[c], choice[c] = gains[k], used[k]
    config, c = np.zeros(len(y), np.int64), capacity
    while c > 0:
        if choice[c]:
            config[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return config, float(best[capacity])


def _covered(demand: np.ndarray, capacity: int, part: float) -> tuple[dict[tuple, float], float]:
    """A cover of ``demand`` by steps of ``part``, and the lower bound of its weights.

    A length's weight is its size (the dual of the bound by volume) times
    ``exp(-rate * covered share)``.  A step covers ``part`` of the demand of the
    length that limits it, so there are at most ``1 / part`` steps a length.
    """
    used, b = np.flatnonzero(demand), demand.astype(float)
    rate = 1 / (4 * part)
    sizes = np.arange(len(demand), dtype=float)
    share, x, low, mean = np.zeros(len(b)), {}, 0.0, np.zeros(len(b))
    while (open_ := used[share[used] < 1 - 1e-9]).size:
        y = np.zeros(len(b))
        y[used] = sizes[used] * np.exp(-rate * (share[used] - share[used].min()))
        config, value = knapsack(y, capacity)
        low = max(low, float(b @ y) / value)
        mean += y / value
        if len(open_) < len(used):  # lengths that are covered already take no more room
            y[np.setdiff1d(used, open_)] = 0
            config, _ = knapsack(y, capacity)
        on = np.flatnonzero(config)
        step = float(np.minimum((1 - share[on]) * b[on] / config[on], (b[on] / config[on]).min() * part).min())
        key = tuple((int(i), int(config[i])) for i in on)
        x[key] = x.get(key, 0.0) + step
        share[on] += step * config[on] / b[on]
    if mean.any():
        low = max(low, float(b @ mean) / knapsack(mean, capacity)[1])
    return x, low


def fractional(demand: np.ndarray, capacity: int, epsilon: float = EPSILON) -> tuple[dict[tuple, float], float]:
    """Configurations with fractional numbers of bins that cover ``demand``, and a lower bound on the program's value.

    Their sum is within ``1 + epsilon`` of the bound, or what steps of ``FINEST`` reach.
    """
    part, best, low = PART, None, 0.0
    while best is None or (sum(best.values()) > (1 + epsilon) * low and part >= FINEST):
        x, bound = _covered(demand, capacity, part)
        low = max(low, bound)
        if best is None or sum(x.values()) < sum(best.values()):
            best = x
        part /= 4
    return best, low


def plan(demand: np.ndarray, capacity: int, epsilon: float = EPSILON) -> tuple[list[tuple[tuple, int]], float]:
    """Whole numbers of bins by configuration that hold all of ``demand`` (by size), and the lower bound.

    Never more bins than best fit needs.
    """
    x, low = fractional(demand, capacity, epsilon)
    left = demand.astype(np.int64).copy()
    bins: list[tuple[tuple, int]] = []
    for config, value in sorted(x.items(), key=lambda kv: -kv[1]):
        n = int(min(np.floor(value + 1e-9), min(left[i] // a for i, a in config)))
        if n > 0:
            bins.append((config, n))
            for i, a in config:
                left[i] -= n * a
    bins += best_fit(left, capacity)
    plain = best_fit(demand, capacity)
    return min(bins, plain, key=lambda found: sum(n for _, n in found)), low


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit decreasing of a histogram of sizes; equal bins are counted together."""
    room: dict[int, dict[tuple, int]] = {}  # by free space: how many bins of which content
    for size in range(len(left) - 1, 0, -1):
        n = int(left[size])
        while n > 0:
            fits = [r for r in room if r >= size]
            if fits:
                r = min(fits)
                content, have = next(iter(room[r].items()))
                take = min(have, n)
                if take == have:
                    del room[r][content]
                    if not room[r]:
                        del room[r]
                else:
                    room[r][content] = have - take
                each = 1
            else:
                r, content, each = capacity, (), max(1, capacity // size)
                take = n // each
                if not take:
                    each, take = n, 1
            n -= take * each
            grown = dict(content)
            grown[size] = grown.get(size, 0) + each
            new = tuple(sorted(grown.items()))
            room.setdefault(r - size * each, {})
            room[r - size * each][new] = room[r - size * each].get(new, 0) + take
    return [(content, n) for by in room.values() for content, n in by.items()]


def slots(bins: list[tuple[tuple, int]], classes: int) -> list[np.ndarray]:
    """By size, rows of (first rank, first bin, items of it in a bin, place of the first in the bin)."""
    rows: list[list[tuple]] = [[] for _ in range(classes)]
    ranks = [0] * classes
    base = 0
    for config, n in bins:
        place = 0
        for size, a in sorted(config, reverse=True):
            rows[size].append((ranks[size], base, a, place))
            ranks[size] += n * a
            place += size * a
        base += n
    return [np.array(r, np.int64).reshape(-1, 4) for r in rows]


def _place(table: list[np.ndarray], grain: int):
    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            rank = batch.column("rank").to_numpy()
            bin_, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                of = np.flatnonzero(size == s)
                t = table[s]
                e = np.searchsorted(t[:, 0], rank[of], "right") - 1
                k = rank[of] - t[e, 0]
                bin_[of] = t[e, 1] + k // t[e, 2]
                offset[of] = (t[e, 3] + k % t[e, 2] * s) * grain
            keep = ["doc_id", "chunk_no", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bin_), pa.array(offset)], [*keep, "bin_id", "bin_offset"])

    return run


def packed(docs: DataFrame, context: int = CONTEXT, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Pieces of documents in bins of ``context`` tokens: ``doc_id, chunk_no, n_tokens, bin_id, bin_offset``.

    Piece ``chunk_no`` of a document starts at its token ``chunk_no * context``.
    Pieces of a bin don't overlap and don't reach beyond it.  Every row is packed,
    rows of one id each on their own and rows without id too.  A text without tokens
    (null or empty) has no piece.  An empty table gives an empty result.  Ids are of any type.
    """
    if context % grain:
        raise ValueError("context must be a multiple of grain")
    n_tokens = token_estimate(text_col) if tokens is None else tokens.cast("long")
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), n_tokens.alias("n")).where("n > 0")
    cut = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / context).cast("int") - 1))
    pieces = rows.select("doc_id", "n", cut.alias("chunk_no")).select("doc_id", "chunk_no", F.least(F.lit(context).cast("long"), F.col("n") - F.col("chunk_no").cast("long") * context).alias("n_tokens"))
    pieces = pieces.withColumn("size", F.ceil(F.col("n_tokens") / grain).cast("int"))
    buckets = shards_for(docs)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    classes = context // grain
    demand = np.zeros(classes + 1, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # one row a size, context / grain at most
        demand[r["size"]] = r["n"]
    full = int(demand[classes])
    demand[classes] = 0
    bins, _ = plan(demand, classes)
    table = slots(bins + ([(((classes, 1),), full)] if full else []), classes + 1)
    before = F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("size", "bucket").orderBy("doc_id", "chunk_no", "n_tokens")) - 1
    ranked = pieces.withColumn("r", rank).join(counts, ["size", "bucket"]).select("doc_id", "chunk_no", "n_tokens", "size", (F.col("before") + F.col("r")).alias("rank"))
    return ranked.mapInArrow(_place(table, grain), f"doc_id {id_type}, chunk_no int, n_tokens long, bin_id long, bin_offset long")

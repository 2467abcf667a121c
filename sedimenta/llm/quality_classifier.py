"""Quality classifier: naive Bayes support vectors (operator 4).

Features are indicators of word and punctuation unigrams and bigrams, hashed to
``DIMS``.  Each is scaled by its class log-count ratio, and a linear model with
hinge loss is fitted to the scaled indicators by dual coordinate descent.  Two heads
are trained, on the labels ``quality`` and ``toxic``.  The fit, ratios included,
uses at most ``max_fit_rows`` labelled documents, chosen by a hash of the id; the
scores cover every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import kernels as K
from .common import is_whole, pack, small, streamed, unpack, written

DIMS = 1 << 20
MAX_FIT_ROWS = 20_000
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
HEADS = ("quality", "toxic")

_KIND = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalnum() else 2
_KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_REPEAT = np.uint64(0x123456789ABCDEF1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all n-grams, repeated ones repeated.

    Words are runs of letters, digits and non-ASCII bytes, in lower case as far as
    ASCII goes; runs of other characters are tokens too.  A bigram of equal tokens is
    one feature, whatever the token.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    h = K.hash_spans(_LOWER[data], starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    pair = doc[1:] == doc[:-1]
    two = K.mix(h[:-1] * np.uint64(3) + h[1:])
    two[h[1:] == h[:-1]] = _REPEAT
    d = np.concatenate([doc, doc[1:][pair]])
    f = np.concatenate([h, two[pair]])
    return d, (f >> np.uint64(16)).astype(np.int64) & (DIMS - 1)


def _sets(batches):
    """(id, text, labels) to packed sets of features."""
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        out = []
        for lo, hi in K.pieces(offsets):
            o = offsets[lo : hi + 1]
            d, f = features(data[o[0] : o[-1]], o - o[0])
            both = np.unique(d * DIMS + f)
            d, f = both // DIMS, (both % DIMS).astype(np.int32)
            cuts = np.searchsorted(d, np.arange(hi - lo + 1))
            out += [pack(f[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(h) for h in HEADS), pa.array(out, pa.binary())], ["id", *HEADS, "features"])


def log_count_ratio(sets: list[np.ndarray], y: np.ndarray, dims: int = DIMS, smoothing: float = SMOOTHING) -> np.ndarray:
    pos, neg = np.zeros(dims), np.zeros(dims)
    for s, positive in zip(sets, y > 0):
        (pos if positive else neg)[s] += 1
    p, q = pos + smoothing, neg + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(sets: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on rows ``r[s]``; classes weigh the same in sum."""
    rng = np.random.default_rng(seed)
    n = len(sets)
    w, bias = np.zeros(len(r)), 0.0
    share = np.where(y > 0, n / 2 / max((y > 0).sum(), 1), n / 2 / max((y < 0).sum(), 1)) * cost
    rows = [r[s] for s in sets]
    square = np.array([float(x @ x) + 1 for x in rows])
    alpha = np.zeros(n)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            s, x = sets[i], rows[i]
            g = y[i] * (float(w[s] @ x) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), share[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[s] += step * y[i] * x
                bias += step * y[i]
                worst = max(worst, abs(step) / share[i])
        if worst < tolerance:
            break
    return w, bias


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    sets = [unpack(v.as_buffer())[0] for v in table.column("features")]
    heads, weights = [], []
    for head in HEADS:
        labels = table.column(head).to_pylist()
        has = [i for i, v in enumerate(labels) if v is not None]
        y = np.array([labels[i] for i in has])
        r = log_count_ratio([sets[i] for i in has], np.where(y > 0, 1, -1)) if has else None
        if r is None or not (y > 0).any() or not (y <= 0).any():
            continue
        w, bias = dual_descent([sets[i] for i in has], np.where(y > 0, 1, -1), r)
        heads.append(head)
        weights.append(pack((w * r).astype(np.float32), np.array([bias])))
    return pa.table({"head": pa.array(heads, pa.string()), "model": pa.array(weights, pa.binary())})


def trained(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> dict[str, tuple[np.ndarray, float]]:
    """Models by head, of fixed size.  A document labelled several times counts with its largest labels, an id of several texts with the first of them."""
    ship(docs.sparkSession)
    kind = "long" if is_whole(docs, id_col) and is_whole(labels, id_col) else "string"
    known = labels.select(F.col(id_col).cast(kind).alias("lid"), *(F.col(h).cast("int").alias(h) for h in HEADS)).where("lid IS NOT NULL")
    known = known.groupBy("lid").agg(*(F.max(h).alias(h) for h in HEADS))
    chosen = written(known.orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(max_fit_rows), "labelled")
    base = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = base.join(F.broadcast(chosen), F.col("id") == F.col("lid")).groupBy("id", *HEADS).agg(F.min("text").alias("text"))  # at most max_fit_rows rows
    sets = streamed(rows, _sets, f"id {'bigint' if kind == 'long' else kind}, quality int, toxic int, features binary")
    models = sets.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "head string, model binary").collect()  # two rows of fixed size
    out = {}
    for row in models:
        w, bias = unpack(bytes(row["model"]))
        out[row["head"]] = (w.copy(), float(bias[0]))
    return out


def _score(models: dict[str, tuple[np.ndarray, float]]):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            margins = {h: [] for h in HEADS}
            used = np.zeros(DIMS, dtype=bool)
            for w, _ in models.values():
                used |= w != 0
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                d, f = features(data[o[0] : o[-1]], o - o[0])
                on = used[f]
                both = np.unique(d[on] * DIMS + f[on])
                d, f = both // DIMS, both % DIMS
                for head in HEADS:
                    if head in models:
                        w, bias = models[head]
                        margins[head].append(np.bincount(d, weights=w[f], minlength=hi - lo) + bias)
            cols = [pa.array(np.concatenate(margins[h]), pa.float64()) if margins[h] else pa.nulls(batch.num_rows, pa.float64()) for h in HEADS]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", *HEADS])

    return run


def classified(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """Every document's margins: ``doc_id, quality_margin, toxic_margin, is_toxic, keep``.

    Margins above 0 are on the side of the label 1.  A document is kept if it is of
    quality and not toxic.  Null and empty texts have no feature: their margins are
    the models' biases.  Where the labels of a head are all alike or there are none,
    its margin is null and it rejects nothing.  Rows without id are left out; every
    other row is scored, equal ones alike.  An empty table gives an empty result.  Ids are
    of any type.
    """
    models = trained(docs, labels, max_fit_rows, id_col, text_col, seed)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    scored = streamed(base, _score(models), f"id {base.schema['id'].dataType.simpleString()}, quality double, toxic double")
    toxic = F.coalesce(F.col("toxic") > 0, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), F.round("quality", 6).alias("quality_margin"), F.round("toxic", 6).alias("toxic_margin"), toxic.alias("is_toxic"), (F.coalesce(F.col("quality") > 0, F.lit(True)) & ~toxic).alias("keep"))

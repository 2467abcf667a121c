"""Brown class-based bigram language model (operator 3).

Every word that occurs twice or more is assigned to one of ``CLASSES`` classes by
exchange clustering; words that occur once are a class of their own.  As in the
original algorithm, the most frequent words (``CORE`` of them at most, a parameter of
the model; words of one count are all in or all out) are clustered first: each moves to the class that raises the likelihood of the
class bigrams most, by the exact change for every class, round by round.  The core is
cut into shards that hold their words' neighbours; within a round a shard exchanges
its words one after the other, starting from the same class counts as the others, and
the counts are taken anew between rounds.  All other words are then inserted, each
into the class that raises the likelihood most, next to the core as it is.

Only the core is sent to the tasks.  The other words, however many, stay in shards by
their hash: a batch of documents sends each shard its words with their neighbours'
classes, and gets their classes and counts back.  What a batch keeps is a class by
token; the transitions are counted over these, and documents are scored from them.

A word's probability is its class's, given the class before (interpolated with the
class's own share), times its share of its class.  Documents are scored by the
perplexity of their words.  All counts are over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import kernels as K
from .common import by_name, by_shard, low, pack, shards_for, streamed, unpack, whole, written

CLASSES = 64
CORE = 1 << 15
ITERATIONS = 6
BLEND = 0.95
#: Core words by shard of the exchange.
SHARD_WORDS = 512
#: Words of at most FEW bigrams are exchanged TOGETHER at a time, from the same class counts.
FEW, TOGETHER = 30, 64
#: Tokens of a batch.
BATCH = 700_000
#: In a sequence of classes: a word beyond the core, before its class is known; no word.
OPEN, NONE = 254, 255


def _tally(shards: int):
    """(id, text) to counts of word hashes by shard, combined by batch."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            parts: list[np.ndarray] = []
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                parts.append(K.words(data[o[0] : o[-1]], o - o[0])[0])
                if sum(map(len, parts)) > BATCH:
                    yield _counted(parts, shards)
                    parts = []
            if any(map(len, parts)):
                yield _counted(parts, shards)

    return run


def _counted(parts: list[np.ndarray], shards: int) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    shard = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    h, n, shard = h[order], n[order], shard[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    on = np.flatnonzero(np.diff(edges))
    # most words are there once or twice: their counts take a byte
    rows = [pack(h[a:b], np.minimum(n[a:b], 255).astype(np.uint8), n[a:b][n[a:b] >= 255]) for a, b in zip(edges[on], edges[on + 1])]
    return pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(rows, pa.binary())], ["shard", "payload"])


def _summed(core: int):
    """In a shard: the ``core`` most frequent of the words that are there twice or more, with their counts."""

    def run(table: pa.Table) -> pa.Table:
        hs, ns = [], []
        for v in table.column("payload"):
            h, n, big = unpack(v.as_buffer())
            n = n.astype(np.int64)
            n[n == 255] = big
            hs.append(h)
            ns.append(n)
        h, n = np.concatenate(hs), np.concatenate(ns)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, n = h[edge], np.add.reduceat(n, edge)
        often = np.flatnonzero(n > 1)
        often = often[np.lexsort((h[often], -n[often]))][:core]
        return pa.table({"h": pa.array(h[often].view(np.int64)), "n": pa.array(n[often])})

    return run


class Vocabulary:
    """The core's word ids by hash: frequent words first; ``size`` stands for all other words, ``size + 1`` for the start."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.lexsort((h, -n))
        self.hashes, self.counts, self.size = h[order], n[order], len(h)
        self.order = np.argsort(self.hashes, kind="stable").astype(np.int32)
        self.sorted = self.hashes[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.size).astype(np.int64)


def _bigrams(vocab: Vocabulary, shards: int, subs: int):
    """(id, text) to counts of (word, next) by shard of each of the two, combined by batch; a shard's batches by ``subs``."""
    wide = vocab.size + 2

    def emit(parts, sub):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        left, right = keys // wide, keys % wide
        out_s, out_p = [], []
        for side, word, other in ((0, left, right), (1, right, left)):
            of = word % shards
            use = word < vocab.size
            order = np.lexsort((other, word, np.where(use, of, shards)))[: int(use.sum())]
            edges = np.searchsorted(of[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)):
                at = order[edges[s] : edges[s + 1]]
                m = n[at]
                out_s.append(int(s) * subs + sub % subs)
                out_p.append(pack(np.array([side], np.uint8), low(word[at].view(np.uint64), 4), low(other[at].view(np.uint64), 4), np.minimum(m, 255).astype(np.uint8), m[m >= 255]))
        return pa.RecordBatch.from_arrays([pa.array(out_s, pa.int32()), pa.array(out_p, pa.binary())], ["shard", "payload"])

    def run(batches):
        sub = TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            parts: list[np.ndarray] = []
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                left, right = chain(vocab, data[o[0] : o[-1]], o - o[0])[:2]
                parts.append(left * wide + right)
                if sum(map(len, parts)) > BATCH:
                    yield emit(parts, sub)
                    parts, sub = [], sub + 1
            if any(map(len, parts)):
                yield emit(parts, sub)

    return run


def chain(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id before, id, word offsets by document) of all words; the start comes before the first."""
    h, firsts = K.words(data, offsets)
    ids = vocab.ids(h)
    left = np.empty_like(ids)
    left[1:] = ids[:-1]
    left[firsts[:-1][np.diff(firsts) > 0]] = vocab.size + 1
    return left, ids, firsts


def _both_sides(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word and other, count) of either side, summed."""
    sides = ([], [])
    for v in table.column("payload"):
        side, word, other, n, big = unpack(v.as_buffer())
        n = n.astype(np.int64)
        n[n == 255] = big
        sides[int(side[0])].append((whole(word, 4).astype(np.int64) << 32 | whole(other, 4).astype(np.int64), n))
    out = []
    for parts in sides:
        key = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        out.append((key[edge], np.add.reduceat(n, edge) if len(edge) else n))
    return out


def _part(subs: int):
    """In a part of a shard: its bigrams, summed and packed again for the shard."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py() // subs
        rows = [pack(np.array([side], np.uint8), low((key >> 32).view(np.uint64), 4), low((key & 0xFFFFFFFF).view(np.uint64), 4), np.minimum(n, 255).astype(np.uint8), n[n >= 255]) for side, (key, n) in enumerate(_both_sides(table)) if len(n)]
        return pa.table({"shard": pa.array([shard] * len(rows), pa.int32()), "payload": pa.array(rows, pa.binary())})

    return run


def _adjacent(table: pa.Table) -> pa.Table:
    """In a shard: (word, other, count) of both sides."""
    cols = [c for key, n in _both_sides(table) for c in ((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n)]
    return pa.table({"payload": pa.array([pack(*cols)], pa.binary())})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(words: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, cls: np.ndarray, counts: np.ndarray, movable: int) -> np.ndarray:
    """New classes of ``words``, moved one after the other.

    ``after[i, c]`` and ``before[i, c]`` count the neighbours of word ``i`` of class
    ``c`` (itself excluded), ``own[i]`` its bigrams with itself, ``counts`` the class
    bigrams; classes from ``movable`` on take no words.  Words of few bigrams
    (``FEW``), which hardly change the counts, move ``TOGETHER`` at a time.
    """
    n = counts.astype(float).copy()
    g = _xlogx(n)  # kept up to date along the rows and columns that change
    rows, cols = n.sum(1), n.sum(0)
    out = cls.copy()
    b = np.arange(movable)

    def shift(k: int, r: np.ndarray, c: np.ndarray, s: float, sign: float) -> None:
        n[k] += sign * r
        n[:, k] += sign * c
        n[k, k] += sign * s
        g[k] = _xlogx(n[k])
        g[:, k] = _xlogx(n[:, k])
        rows[k] += sign * (r.sum() + s)
        cols[k] += sign * (c.sum() + s)
        rows[:] += sign * c
        cols[:] += sign * r

    few = after.sum(1) + before.sum(1) + own <= FEW
    for i in np.flatnonzero(~few):
        r, c, s, a = after[i].astype(float), before[i].astype(float), float(own[i]), int(out[i])
        shift(a, r, c, s, -1.0)
        on_r, on_c = np.flatnonzero(r), np.flatnonzero(c)
        gain = _xlogx(n[:movable, on_r] + r[on_r]).sum(1) - g[:movable, on_r].sum(1)
        gain += _xlogx(n[on_c, :movable] + c[on_c][:, None]).sum(0) - g[on_c, :movable].sum(0)
        # the cell (b, b) takes part of both and the word's own bigrams
        d = n[b, b]
        gain += _xlogx(d + r[b] + c[b] + s) - _xlogx(d + r[b]) - _xlogx(d + c[b]) + g[b, b]
        # the neighbours' margins grow whatever b is; on top of that, b's row and column
        row, col = rows[b] + c[b], cols[b] + r[b]
        gain -= _xlogx(row + r.sum() + s) - _xlogx(row)
        gain -= _xlogx(col + c.sum() + s) - _xlogx(col)
        best = int(np.argmax(gain))
        if gain[best] <= gain[a] + 1e-9:
            best = a
        out[i] = best
        shift(best, r, c, s, 1.0)
    rest = np.flatnonzero(few)
    for lo in range(0, len(rest), TOGETHER):
        at = rest[lo : lo + TOGETHER]
        was = out[at].astype(np.int64)
        r, c, s = after[at].astype(float), before[at].astype(float), own[at].astype(float)
        gain = _gains(r, c, s, was, n, movable)
        best = np.argmax(gain, 1)
        each = np.arange(len(at))
        moves = np.flatnonzero(gain[each, best] > gain[each, was] + 1e-9)
        for k in moves:
            for to, sign in ((was[k], -1.0), (best[k], 1.0)):
                n[to] += sign * r[k]
                n[:, to] += sign * c[k]
                n[to, to] += sign * s[k]
        out[at[moves]] = best[moves]
    return out


def _gains(r: np.ndarray, c: np.ndarray, s: np.ndarray, a: np.ndarray, n: np.ndarray, movable: int) -> np.ndarray:
    """(word, class): what each word adds to the likelihood in each class, taken out of its class ``a`` alone."""
    m, b = len(a), np.arange(movable)
    gain = np.zeros((m, movable))
    for mine, other, cells in ((r, c, n.T), (c, r, n)):
        # cells[j, b] counts class b with its neighbour j; what the word has in them is taken out
        w, j = np.nonzero(mine)
        x, e = mine[w, j], np.arange(len(w))
        t = cells[j, :movable]
        home = j == a[w]
        t[home] -= other[w[home], :movable]
        t[e, a[w]] -= x + np.where(home, s[w], 0)
        if len(w):
            firsts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[firsts]] += np.add.reduceat(_xlogx(t + x[:, None]) - _xlogx(t), firsts)
    own = b == a[:, None]
    d = n[b, b] - own * (r[:, :movable] + c[:, :movable] + s[:, None])
    rb, cb = r[:, :movable], c[:, :movable]
    gain += _xlogx(d + rb + cb + s[:, None]) - _xlogx(d + rb) - _xlogx(d + cb) + _xlogx(d)
    for mine, other, sums in ((r, c, n.sum(1)), (c, r, n.sum(0))):
        total = mine.sum(1, keepdims=True) + s[:, None]
        margin = sums[:movable] - own * total
        gain -= _xlogx(margin + total) - _xlogx(margin)
    return gain


def _neighbours(payload, cls: np.ndarray, width: int):
    """(words, after, before, own) by class from a shard's packed bigrams."""
    lw, lo_, ln, rw, ro, rn = unpack(payload)
    words = np.union1d(lw, rw)
    out = []
    own = np.zeros(len(words), np.int64)
    for k, (w, o, n) in enumerate(((lw, lo_, ln), (rw, ro, rn))):
        at = np.searchsorted(words, w)
        self_ = w == o
        if k == 0:
            own = np.bincount(at[self_], weights=n[self_], minlength=len(words)).astype(np.int64)
        key = at[~self_].astype(np.int64) * width + cls[o[~self_]]
        out.append(np.bincount(key, weights=n[~self_], minlength=len(words) * width).reshape(len(words), width))
    return words, out[0], out[1], own


def _step(cls: np.ndarray, counts: np.ndarray | None, movable: int):
    """A shard's exchange; without ``counts`` only a task's share of the class bigrams under ``cls``."""
    width = movable + 2

    def run(batches):
        share = np.zeros((width, width))
        for batch in batches:
            for v in batch.column("payload"):
                words, after, before, own = _neighbours(v.as_buffer(), cls, width)
                a = cls[words].astype(np.int64)
                if counts is not None:
                    new = exchange(words, after, before, own, a, counts, movable)
                    yield pa.RecordBatch.from_arrays([pa.array([pack(words.astype(np.int32), new.astype(np.int16))], pa.binary())], ["payload"])
                    continue
                np.add.at(share, a, after)
                np.add.at(share, (a, a), own)
                # bigrams whose first word is no vocabulary word are counted from the second's side
                for c in (movable, movable + 1):
                    np.add.at(share[c], a, before[:, c])
        if counts is None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(share.ravel())], pa.binary())], ["payload"])

    return run


class Core:
    """The core's classes and the class bigrams around it; ``classes`` stands for all other words, ``classes + 1`` for the start."""

    def __init__(self, vocab: Vocabulary, cls: np.ndarray, counts: np.ndarray):
        self.vocab, self.cls, self.counts, self.classes = vocab, cls.astype(np.uint8), counts, len(counts) - 2


def inserted(after: np.ndarray, before: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most when the word's bigrams are added to it.

    ``after[i, c]`` and ``before[i, c]`` count the neighbours of word ``i`` of class
    ``c``.  Classes are those of ``counts`` but the last two.
    """
    width = len(counts)
    movable = width - 2
    n = counts.astype(float)
    gain = np.zeros((len(after), movable))
    for mine, cells in ((after, n.T), (before, n)):
        cells = np.ascontiguousarray(cells[:, :movable])
        base = _xlogx(cells)
        w, j = np.nonzero(mine)
        x = mine[w, j]
        if not len(w):
            continue
        # most words meet a class a few times: these changes are in a table
        step = np.stack([_xlogx(cells + k) - base for k in range(1, 5)])
        value = step[np.minimum(x, 4) - 1, j]
        more = np.flatnonzero(x > 4)
        value[more] = _xlogx(cells[j[more]] + x[more, None]) - base[j[more]]
        firsts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[firsts]] += np.add.reduceat(value, firsts)
    # the cell (b, b) takes part of both
    w, b = np.nonzero((after[:, :movable] > 0) & (before[:, :movable] > 0))
    d, r, c = n[b, b], after[w, b], before[w, b]
    gain[w, b] += _xlogx(d + r + c) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
    for mine, sums in ((after, n.sum(1)), (before, n.sum(0))):
        total = mine.sum(1, keepdims=True)
        gain -= _xlogx(sums[:movable] + total) - _xlogx(sums[:movable])
    return np.argmax(gain, 1)


def _ipc(column: pa.Array) -> np.ndarray:
    """A column as bytes, whatever its type."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _ask(core: Core, shards: int):
    """(id, text) to packed rows (shard, batch, payload).

    A batch is named by its partition and its number there.  Its words beyond the core
    go to their shards: hash, count, then the classes before and after each
    occurrence.  Its documents (classes by token, the open ones by place) go past the
    shards, under a negative shard, to the batch's home.
    """
    vocab = core.vocab
    log_n = np.log(np.r_[np.maximum(vocab.counts, 1), 1.0].astype(float))

    def emit(ids, parts, name):
        h, ids_, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        firsts = np.r_[0, np.cumsum(sizes)]
        seq = core.cls[ids_]
        left, right = np.empty_like(seq), np.empty_like(seq)
        left[1:], right[:-1] = seq[:-1], seq[1:]
        has = sizes > 0
        left[firsts[:-1][has]] = core.classes + 1
        right[firsts[1:][has] - 1] = NONE
        sums = np.r_[0.0, np.cumsum(log_n[ids_])]
        open_ = np.flatnonzero(ids_ == vocab.size)
        seq[open_] = OPEN
        words, inverse, n = np.unique(h[open_], return_inverse=True, return_counts=True)
        shard = (words >> np.uint64(40)) % np.uint64(shards)
        order = by_name(shard, shards)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        inverse = place[inverse]
        words, n, shard = words[order], n[order], shard[order].astype(np.int64)
        by_word = np.argsort(inverse, kind="stable")
        l, r = left[open_][by_word], right[open_][by_word]
        at = np.r_[0, np.cumsum(n)]
        out_s, out_p = [-1 - (name ^ name >> 32) % shards], [pack(_ipc(ids), sizes.astype(np.uint32), sums[firsts[1:]] - sums[firsts[:-1]], seq, inverse)]
        on = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(on, np.r_[on[1:], len(shard)]):
            out_s.append(int(shard[a]))
            out_p.append(pack(low(words[a:b], 5), np.minimum(n[a:b], 255).astype(np.uint8), n[a:b][n[a:b] >= 255], l[at[a] : at[b]], r[at[a] : at[b]]))
        return pa.RecordBatch.from_arrays([pa.array(out_s, pa.int32()), pa.array([name] * len(out_s), pa.int64()), pa.array(out_p, pa.binary())], ["shard", "batch", "payload"])

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            parts, first, held = [], 0, 0
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                h, firsts = K.words(data[o[0] : o[-1]], o - o[0])
                parts.append((h, vocab.ids(h), np.diff(firsts)))
                held += len(h)
                if held > BATCH or hi == batch.num_rows:
                    yield emit(batch.column(0).slice(first, hi - first), parts, name)
                    parts, first, held, name = [], hi, 0, name + 1

    return run


def _answer(core: Core):
    """In a shard: words beyond the core get their class, by insertion, and their count; both go home, to their batches."""
    rare = core.classes

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        batches = table.column("batch").to_pylist()
        if shard < 0:
            return pa.table({"of": pa.array([-1] * len(batches), pa.int32()), "batch": table.column("batch"), "payload": table.column("payload")})
        parts = []
        for v in table.column("payload"):
            h, n, big, l, r = unpack(v.as_buffer())
            n = n.astype(np.int64)
            n[n == 255] = big
            parts.append((whole(h, 5), n, l, r))
        sizes = np.array([len(p[0]) for p in parts])
        h, n, l, r = (np.concatenate([p[i] for p in parts]) for i in range(4))
        words, of = np.unique(h, return_inverse=True)
        total = np.bincount(of, weights=n, minlength=len(words)).astype(np.int64)
        each = np.repeat(of, n)
        often = total[each] > 1
        each, l, r = each[often], l[often].astype(np.int64), r[often].astype(np.int64)
        order = np.argsort(each, kind="stable")
        each, l, r = each[order], l[order], r[order]
        cls = np.full(len(words), rare, np.uint8)
        many = np.flatnonzero(total > 1)
        for lo in range(0, len(many), 1024):
            some = many[lo : lo + 1024]
            a, b = np.searchsorted(each, [some[0], some[-1] + 1])
            row = np.searchsorted(some, each[a:b])
            width = rare + 2
            count = lambda side: np.bincount(row[side != NONE] * width + side[side != NONE], minlength=len(some) * width).reshape(len(some), width)  # noqa: B023, E731
            cls[some] = inserted(count(r[a:b]), count(l[a:b]), core.counts)
        at = np.r_[0, np.cumsum(sizes)]
        rows = [pack(cls[of[a:b]], total[of[a:b]].astype(np.uint64)) for a, b in zip(at[:-1], at[1:])]
        return pa.table({"of": pa.array([shard] * len(rows), pa.int32()), "batch": pa.array(batches, pa.int64()), "payload": pa.array(rows, pa.binary())})

    return run


def _settle(table: pa.Table) -> pa.Table:
    """At home: documents as classes by token, with the sum of the logarithms of their words' counts."""
    order = np.argsort(table.column("of").to_numpy(), kind="stable")
    replies, home = [], None
    for k in order:
        p = unpack(table.column("payload")[int(k)].as_buffer())
        if table.column("of")[int(k)].as_py() < 0:
            home = p
        else:
            replies.append(p)
    ids, sizes, sums, seq, inverse = home
    seq, sums = seq.copy(), sums.copy()
    if replies:
        cls, n = (np.concatenate([p[i] for p in replies]) for i in range(2))
        open_ = np.flatnonzero(seq == OPEN)
        seq[open_] = cls[inverse]
        doc = np.searchsorted(np.cumsum(sizes.astype(np.int64)), open_, "right")
        sums += np.bincount(doc, weights=np.log(n.astype(float))[inverse], minlength=len(sizes))
    return pa.table({"payload": pa.array([pack(ids, sizes, sums, seq)], pa.binary())})


def _before(sizes: np.ndarray, seq: np.ndarray, start: int) -> np.ndarray:
    """The class before each token."""
    left = np.empty_like(seq)
    left[1:] = seq[:-1]
    firsts = np.cumsum(sizes.astype(np.int64)) - sizes
    left[firsts[sizes > 0]] = start
    return left


def _cells(width: int):
    """Settled batches to a task's counts of class bigrams: (cell, n), at most ``width`` squared of them."""

    def run(batches):
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for v in batch.column("payload"):
                _, sizes, _, seq = unpack(v.as_buffer())
                total += np.bincount(_before(sizes, seq, width - 1).astype(np.int64) * width + seq, minlength=width * width)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    return run


class Model:
    """Class transitions, and the share that one occurrence has in its class, as logarithms."""

    def __init__(self, counts: np.ndarray, blend: float = BLEND):
        width = len(counts)
        into = counts.sum(0) + 1.0
        into[width - 1] = 0.0  # nothing leads to the start
        share = into / into.sum()
        rows = counts.sum(1, keepdims=True)
        self.transition = np.log(np.maximum(np.where(rows > 0, blend * counts / np.maximum(rows, 1), 0) + np.where(rows > 0, 1 - blend, 1.0) * share, 1e-300))
        total = counts.sum(0).astype(float)
        total[width - 2] += 1  # a word that was never seen is one more of those seen once
        self.one = -np.log(np.maximum(total, 1))


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for v in batch.column("payload"):
                ids, sizes, sums, seq = unpack(v.as_buffer())
                lp = model.transition[_before(sizes, seq, len(model.one) - 1), seq] + model.one[seq]
                total = sums.copy()
                has = sizes > 0
                firsts = np.cumsum(sizes.astype(np.int64)) - sizes
                if len(lp):
                    total[has] += np.add.reduceat(lp, firsts[has])
                named = pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_all().column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([named, pa.array(sizes.astype(np.int64)), pa.array(total)], ["id", "n_words", "log_prob"])

    return run


def likelihood(n: np.ndarray) -> float:
    """Of class bigrams, up to what doesn't depend on the classes."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(0)).sum() - _xlogx(n.sum(1)).sum())


def raised(cls: np.ndarray, new: np.ndarray, counts: np.ndarray, class_counts: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts after the moves from ``cls`` to ``new``, or after a half, a quarter and so on of them, until the likelihood rises.

    Each shard made its moves from the same counts, so together they may go too far.  The
    first word that moved is always among them: no move came before it in its shard, so
    its gain is exact.
    """
    words = np.flatnonzero(new != cls)
    order = np.r_[words[:1], np.random.default_rng(len(words)).permutation(words[1:])]
    before = likelihood(counts)
    while len(order):
        some = cls.copy()
        some[order] = new[order]
        moved = class_counts(some)
        if likelihood(moved) > before:
            return some, moved
        order = order[: len(order) // 2]
    return cls, counts


def trained(base: DataFrame, shards: int, classes: int = CLASSES, core: int = CORE, iterations: int = ITERATIONS) -> Core:
    """The core of all texts of ``base(id, text)``, clustered."""
    tally = streamed(base, _tally(shards), "shard int, payload binary")
    words = written(by_shard(tally, _summed(core), "h long, n long"), "words")
    # the least count of which there are no more than ``core`` words; a row a distinct count
    least, many = 2, 0
    for row in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(core + 1).collect():
        many += row["k"]
        if many > core:
            least = row["n"] + 1
            break
    found = words.where(F.col("n") >= least).toPandas()  # 16 bytes a core word
    vocab = Vocabulary(found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))
    cls = np.r_[np.arange(vocab.size) % classes, classes, classes + 1].astype(np.int16)
    parts, width = max(1, -(-vocab.size // SHARD_WORDS)), classes + 2
    subs = max(1, shards // parts)  # a shard's bigrams are summed in as many parts as the input asks for
    pairs = streamed(base, _bigrams(vocab, parts, subs), "shard int, payload binary")
    pairs = by_shard(pairs, _part(subs), "shard int, payload binary") if subs > 1 else pairs
    adjacent = written(by_shard(pairs, _adjacent, "payload binary"), "adjacent")

    def class_counts(cls: np.ndarray) -> np.ndarray:
        total = np.zeros(width * width)
        for row in adjacent.mapInArrow(_step(cls, None, classes), "payload binary").collect():  # a matrix of classes by task, of which there are no more than shards of the core
            total += unpack(bytes(row["payload"]))[0]
        return total.reshape(width, width)

    counts = class_counts(cls)
    for _ in range(iterations if vocab.size else 0):
        new = cls.copy()
        for row in adjacent.mapInArrow(_step(cls, counts, classes), "payload binary").collect():  # the core's classes, 6 bytes a word
            w, c = unpack(bytes(row["payload"]))
            new[w] = c
        if not (new != cls).any():
            break
        cls, counts = raised(cls, new, counts, class_counts)
    return Core(vocab, cls, counts)


def settled(base: DataFrame, core: Core, shards: int) -> DataFrame:
    """Packed batches of documents as classes by token; words beyond the core inserted on the way."""
    asked = streamed(base, _ask(core, shards), "shard int, batch long, payload binary")
    home = by_shard(asked, _answer(core), "of int, batch long, payload binary")
    return written(by_shard(home, _settle, "payload binary", "batch"), "settled")


def perplexities(docs: DataFrame, classes: int = CLASSES, core: int = CORE, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's score: ``doc_id, perplexity, log_prob, n_words``.

    The model is trained on all texts and then scores each of them whole.
    Documents without words (null, empty, white space) have log-probability 0 and no
    perplexity.  Rows without id are left out; equal rows count, and are scored, each.
    An empty table gives an empty result.  Ids are of any type.
    """
    if not 1 <= classes <= 250:
        raise ValueError("classes must be between 1 and 250")
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    shards = shards_for(docs)
    found = settled(base, trained(base, shards, classes, core, iterations), shards)
    counts = np.zeros((classes + 2) ** 2)
    for row in streamed(found, _cells(classes + 2), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # the squared number of classes at most
        counts[row["cell"]] = row["n"]
    scored = streamed(found, _score(Model(counts.reshape(classes + 2, classes + 2))), f"id {base.schema['id'].dataType.simpleString()}, n_words long, log_prob double")
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words")))
    return scored.select(F.col("id").alias("doc_id"), F.round(perplexity, 6).alias("perplexity"), F.round("log_prob", 6).alias("log_prob"), "n_words")

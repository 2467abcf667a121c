"""N-gram Jaccard join by vertical partitioning (operator 7).

Documents are sets of word n-grams (``kernels.grams``).  All n-grams stand in
one global order, by the binary logarithm of their document frequency, then by
hash: rare ones first.  The order is cut into fragments; a fragment holds the
segment of every document that falls into it, counts the overlap of pairs of
segments on its own, and the partial counts are summed per pair.

What keeps this far from quadratic, all of it exact:

* Documents with the same n-gram set are one entity (``sig``).
* N-grams of one entity only can't add to an overlap.  They are left out after
  their count; an entity whose other n-grams are fewer than ``threshold`` of its
  set has no partner.
* A pair is counted only if it shares an n-gram of both prefixes (the first
  ``size - ceil(threshold * size) + 1`` n-grams in the global order), if the sizes
  are compatible, and if the n-grams that remain from there on can still reach the
  overlap that the threshold asks for.  An entity brings 128 bits, one or more of its
  n-grams behind each that is set: bits of only one of a pair are n-grams of only one,
  which bounds the overlap of short texts that share a phrase.
* A pair goes only to the fragments in which both of its entities have a segment;
  pairs of a fragment that has many are spread over several tasks.

* A large group of edited copies has as many pairs as the square of its entities.
  First every n-gram of many entities compares all of them with its few central
  ones; entities that such pairs link are a group.  Two entities of one group are
  never a row: a group's links are counted in blocks, as products of 0-1 matrices
  over all n-grams that its entities share, and only the counts leave a task.

Within a fragment, n-grams of few entities give their pairs one by one; those of
many are multiplied as blocks of 0-1 matrices.  Nothing is capped.  Between stages the n-grams travel as packed arrays by
(batch, shard), 5 bytes each, not as rows.  Two n-grams count as one if they
fall into one shard and agree in 40 further bits of their hash (a shard of 8 MB of
text has about a million: fewer than one expected false pair in it); two sets are
one if their 64-bit signatures agree (expected false pairs among n sets:
n * n / 2**65, so 0.03 at a thousand million).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import by_name, by_shard, decode, encode, fresh, give_back, key_of, low, named, pack, pick, ranges, shards_for, small, streamed, unpack, whole, written

N = 3
THRESHOLD = 0.5
#: Shards for which the fullest part of the order is cut once more.
SHARDS_BY_RANGE = 12
#: Parts of the order, by half binary logarithms of the frequency.
LEVELS = 16
#: Candidate pairs of a fragment that one task counts.
PAIRS_BY_TASK = 250_000
#: N-grams of at most so many entities give their pairs one by one; others in tiles.
FEW, TILE = 24, 512
#: Central entities of an n-gram of many; entities from which on linked ones are a group.
CENTRAL, GROUP = 4, 64
#: N-grams of a block of a group; n-grams of at most so many entities of two blocks give their pairs one by one.
BLOCK, RARE = 2_000_000, 8
_SLACK = 1e-9


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - _SLACK).astype(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """Distinct grams by document: (grams, firsts, signature, size)."""
    g, doc = K.distinct(*K.grams(*K.words(data, offsets), n))
    firsts = np.searchsorted(doc, np.arange(len(offsets)))
    size = np.diff(firsts)
    sig = np.zeros(len(size), np.uint64)
    if len(g):
        has = size > 0
        sig[has] = np.add.reduceat(K.mix(g ^ np.uint64(0x5851F42D4C957F2D)), firsts[:-1][has])
    return g, firsts, K.mix(sig + size.astype(np.uint64)), size


def _members(n: int):
    """(id, text) to (id, sig, size) of documents that have a word."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                _, _, sig, size = _sets(data[o[0] : o[-1]], o - o[0], n)
                has = size > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][has]), pa.array(sig[has].view(np.int64)), pa.array(size[has].astype(np.int64))], ["id", "sig", "size"])

    return run


def _scatter(n: int, shards: int):
    """(id, text) of representatives to packed rows (shard, batch, payload).

    A batch is named by its partition and its number there.  Its grams go to their
    shards with the entities' places in the batch; its directory (signatures and
    sizes) goes past the shards, under a negative shard, to the batch's home.
    """

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            parts: list[tuple] = []
            held = 0
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                g, firsts, sig, size = _sets(data[o[0] : o[-1]], o - o[0], n)
                parts.append((g, sig[size > 0], size[size > 0]))
                held += len(g)
                if held > 1_000_000:
                    yield _by_shard(parts, shards, name)
                    parts, held, name = [], 0, name + 1
            if held:
                yield _by_shard(parts, shards, name)
                name += 1

    return run


def _rows(key: str, keys: list[int], batches: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table({key: pa.array(keys, pa.int32()), "batch": pa.array(batches, pa.int64()), "payload": pa.array(payloads, pa.binary())})


def _by_shard(parts: list[tuple], shards: int, name: int) -> pa.RecordBatch:
    g, sig, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
    doc = np.repeat(np.arange(len(size)), size)
    shard = (g >> np.uint64(40)) % np.uint64(shards)
    order = by_name(shard, shards)
    g, doc, shard = g[order], doc[order], shard[order].astype(np.int64)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    out_s, out_p = [-1 - (name ^ name >> 32) % shards], [pack(sig, size.astype(np.uint32))]
    for s in np.flatnonzero(np.diff(edges)):
        a, b = edges[s], edges[s + 1]
        out_s.append(int(s))
        out_p.append(pack(encode(np.diff(doc[a:b], prepend=0)), low(g[a:b], 5)))
    return _rows("shard", out_s, [name] * len(out_s), out_p).to_batches()[0]


def _segments(table: pa.Table, columns: int) -> list[np.ndarray]:
    """The packed columns of all rows, one after the other."""
    parts = [unpack(v.as_buffer()) for v in table.column("payload")]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(columns)]


def _frequencies(table: pa.Table) -> pa.Table:
    """In a shard: document frequency of each gram; those of two entities or more go home, to their batch."""
    shard = table.column("shard")[0].as_py()
    batches = table.column("batch").to_pylist()
    if shard < 0:
        return _rows("of", [-1] * len(batches), batches, [v.as_py() for v in table.column("payload")])
    parts = [unpack(v.as_buffer()) for v in table.column("payload")]
    doc = [np.cumsum(decode(p[0])) for p in parts]
    g = whole(np.concatenate([p[1] for p in parts]), 5)
    order = np.argsort(g, kind="stable")
    s = g[order]
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    df = np.diff(np.r_[edge, len(s)])
    freq = np.empty(len(g), np.uint32)
    freq[order] = np.repeat(df, df)
    level = np.log2(freq).astype(np.uint8)
    out_b, out_p, at = [], [], 0
    for name, d in zip(batches, doc):
        own = slice(at, at + len(d))
        at += len(d)
        keep = level[own] > 0
        if keep.any():
            out_b.append(name)
            out_p.append(pack(encode(np.diff(d[keep], prepend=0)), low(g[own][keep], 5), level[own][keep]))
    return _rows("of", [shard] * len(out_b), out_b, out_p)


def layout(parts: int) -> np.ndarray:
    """Number of the first fragment of each level, and of all: fuller (rarer) levels have more."""
    return np.concatenate([[0], np.cumsum([max(1, parts >> k) for k in range(LEVELS)])])


def _entities(table: pa.Table, columns: int, own: int = 0) -> list[np.ndarray]:
    """A fragment's segments (ids, count, ``own`` columns by entity, columns by n-gram), one of each entity (an id of several texts may bring an entity twice)."""
    sig, count, *cols = _segments(table, 2 + own + columns)
    count = count.astype(np.int64)
    _, first = np.unique(sig, return_index=True)
    mine, cols = cols[:own], cols[own:]
    if len(first) < len(sig):
        at = ranges((np.cumsum(count) - count)[first], count[first])
        mine = [c.reshape(len(sig), -1)[first].ravel() for c in mine]
        sig, count, cols = sig[first], count[first], [c.reshape(-1, len(c) // max(int(count.sum()), 1))[at].ravel() for c in cols]
    return [sig, count, *mine, *cols]


def _cut(threshold: float, parts: int):
    """At home: entities that may have a partner, their grams put in the global order and cut into fragments.

    Rows of ``kind`` 0 hold a fragment's segments, of 1 the prefixes in it, of 2 (no
    fragment) the entities with their sizes and the fragments that they are in.
    """
    starts = layout(parts)
    width = -(-int(starts[-1]) // 8)

    def run(table: pa.Table) -> pa.Table:
        docs, grams, levels, ids = [], [], [], None
        for of, p in zip(table.column("of").to_pylist(), table.column("payload")):
            p = unpack(p.as_buffer())
            if of < 0:
                ids, full = p[0], p[1].astype(np.int64)
            else:
                docs.append(np.cumsum(decode(p[0])))
                grams.append(whole(p[1], 5) | np.uint64(of << 40))
                levels.append(p[2])
        out_k, out_f, out_p = [], [], []
        if docs:
            doc, g, level = np.concatenate(docs).astype(np.int32), K.mix(np.concatenate(grams)), np.concatenate(levels)
            m = np.bincount(doc, minlength=len(ids))
            keep = (m >= _ceil(threshold * full))[doc]
            g, level, doc = g[keep], level[keep], doc[keep]
            order = np.lexsort((g, level, doc))
            g, level, doc = g[order], level[order], doc[order]
            firsts = np.searchsorted(doc, np.arange(len(ids) + 1))
            rest = m[doc] - (np.arange(len(g)) - firsts[doc])  # grams from here on that others have too
            ahead = full[doc] - rest  # of the whole set, grams of one entity only come first in the order
            prefix = ahead < full[doc] - _ceil(threshold * full[doc]) + 1
            level = np.minimum(level // 2, LEVELS - 1)
            frag = (starts[level] + ((g >> np.uint64(48)) % np.diff(starts)[level].astype(np.uint64)).astype(np.int64)).astype(np.int32)
            order = np.lexsort((doc, frag))
            f_sorted = frag[order]
            edges = np.flatnonzero(np.r_[True, f_sorted[1:] != f_sorted[:-1]]) if len(order) else np.zeros(0, np.int64)
            bits = np.zeros((len(ids), 128), bool)
            bits[doc, (g & np.uint64(127)).astype(np.int64)] = True
            bits = np.packbits(bits, axis=1).view(np.uint64)
            seen = np.zeros((len(ids), width * 8), bool)
            for lo, hi in zip(edges, np.r_[edges[1:], len(order)]):
                at, f = order[lo:hi], int(f_sorted[lo])
                seen[doc[at], f] = True
                for kind, of in ((0, at), (1, at[prefix[at]])):
                    if not len(of):
                        continue
                    d = doc[of]
                    new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    who = d[new]
                    n = np.diff(np.r_[new, len(d)]).astype(np.uint32)
                    out_k.append(kind)
                    out_f.append(f)
                    out_p.append(pack(ids[who], n, low(g[of], 6)) if kind == 0 else pack(ids[who], n, bits[who].ravel(), m[who].astype(np.uint32), low(g[of], 6), rest[of].astype(np.uint32), np.repeat(full[who], n).astype(np.uint32)))
            there = np.flatnonzero(seen.any(1))
            if len(there):
                out_k.append(2)
                out_f.append(-1)
                out_p.append(pack(ids[there], full[there].astype(np.uint32), np.packbits(seen[there], axis=1).ravel()))
        return pa.table({"kind": pa.array(out_k, pa.int32()), "frag": pa.array(out_f, pa.int32()), "payload": pa.array(out_p, pa.binary())})

    return run


def _directory(batches):
    """Packed directories to rows (sig, size, in_frags)."""
    for batch in batches:
        for p in batch.column("payload"):
            ids, size, seen = unpack(p.as_buffer())
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(seen) // len(ids)), len(ids), [None, pa.py_buffer(seen.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(size.astype(np.int32)), bits.cast(pa.binary())], ["sig", "size", "in_frags"])


def _spread(*flags: str):
    """Rows to one in each fragment that all ``flags`` name; the other columns stay."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(lo, 1 << 14)
                if not part.num_rows:
                    continue
                both = np.bitwise_and.reduce([K.buffers(part.column(c))[0].reshape(part.num_rows, -1) for c in flags])
                row, frag = np.nonzero(np.unpackbits(both, axis=1))
                names = [c for c in part.schema.names if c not in flags]
                yield pa.RecordBatch.from_arrays([pa.array(frag.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in names)], ["frag", *names])

    return run


def _reach(threshold: float, s: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The largest partner of a set of size ``s`` that ``rest`` common n-grams allow."""
    return np.floor(rest / (threshold / (1 + threshold)) + _SLACK).astype(np.int64) - s


def _one_by_one(g, doc, s, far, threshold: float, found) -> None:
    """Pairs of n-grams of few entities, positions included; arrays are ordered by (g, s)."""
    span = int(s.max()) + 1
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    rank = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    ends = np.r_[edge[1:], len(g)][rank]
    # partners of the smaller one: later in the order, of at most min(far, s / threshold)
    top = np.minimum(np.minimum(far, np.floor(s / threshold + _SLACK).astype(np.int64)), span - 1)
    last = np.minimum(np.searchsorted(rank * span + s, rank * span + top, "right"), ends)
    n = np.where(far >= s, np.maximum(last - np.arange(len(g)) - 1, 0), 0)
    for lo, hi in _chunks(n, 500_000):
        x = np.repeat(np.arange(lo, hi), n[lo:hi])
        y = ranges(np.arange(lo, hi) + 1, n[lo:hi])
        fit = far[y] >= s[x]
        found(doc[x[fit]], doc[y[fit]])


def _in_tiles(g, doc, size, label, threshold: float, found) -> None:
    """Pairs that share an n-gram of many entities, but no group: products of tiles of the entity-by-n-gram matrix."""
    who, row = np.unique(doc, return_inverse=True)
    grams, col = np.unique(g, return_inverse=True)
    # alike entities stand together: by their group, then by the least of their n-grams
    least = np.full(len(who), len(grams), np.int64)
    np.minimum.at(least, row, col)
    order = np.lexsort((who, least, label[who]))
    place = np.empty(len(who), np.int64)
    place[order] = np.arange(len(who))
    who, row = who[order], place[row]
    at = np.lexsort((col, row))
    row, col = row[at], col[at]
    cuts = np.searchsorted(row, np.arange(0, len(who) + TILE, TILE))
    tiles = []
    for k in range(len(cuts) - 1):
        used, local = np.unique(col[cuts[k] : cuts[k + 1]], return_inverse=True)
        m = np.zeros((min(TILE, len(who) - k * TILE), len(used)), np.float32)
        m[row[cuts[k] : cuts[k + 1]] - k * TILE, local] = 1
        tiles.append((used, m))
    sizes, label = size[who].astype(np.int64), label[who]
    for i, (gi, mi) in enumerate(tiles):
        one = label[i * TILE]
        for j in range(i, len(tiles)):
            if one >= 0 and label[min((j + 1) * TILE, len(who)) - 1] == one:
                continue
            gj, mj = tiles[j]
            both, pi, pj = np.intersect1d(gi, gj, assume_unique=True, return_indices=True)
            if not len(both):
                continue
            x, y = np.nonzero(mi[:, pi] @ mj[:, pj].T > 0)
            x, y = x + i * TILE, y + j * TILE
            a, b = sizes[x], sizes[y]
            fit = (x < y) & (np.minimum(a, b) >= _ceil(threshold * np.maximum(a, b)))
            found(who[x[fit]], who[y[fit]])


class _Found:
    """Distinct pairs of places in ``sig`` that their bits allow; ``label`` names their groups (-1: none), two of one group are left out."""

    def __init__(self, sig: np.ndarray, size: np.ndarray, bits: np.ndarray, shared: np.ndarray, label: np.ndarray, threshold: float):
        self.sig, self.size, self.bits, self.shared, self.label = sig, size, bits.reshape(-1, 2), shared.astype(np.int64), label
        self.share, self.codes, self.held, self.done = threshold / (1 + threshold), [], 0, []

    def __call__(self, x: np.ndarray, y: np.ndarray) -> None:
        differ = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(1, dtype=np.int64)
        fit = (self.shared[x] + self.shared[y] - differ) // 2 >= _ceil(self.share * (self.size[x] + self.size[y]))
        fit &= (self.label[x] != self.label[y]) | (self.label[x] < 0)
        x, y = x[fit], y[fit]
        self.codes.append(np.minimum(x, y) * len(self.sig) + np.maximum(x, y))
        self.held += len(x)
        if self.held > 1_500_000:
            self.done.append(np.unique(np.concatenate(self.codes)))
            self.codes, self.held = [], 0

    def table(self) -> pa.Table:
        parts, n = self.done + self.codes, max(len(self.sig), 1)
        pairs = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        a, b = self.sig[pairs // n].view(np.int64), self.sig[pairs % n].view(np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _prefixes(table: pa.Table, threshold: float):
    """A fragment's prefixes, ordered by n-gram and size: ((signatures, their sizes, bits, n-grams that others have), then by n-gram: itself, entity, size, reach, n-grams ahead, entities that have it)."""
    sig, count, bits, shared, g, rest, s = _entities(table, 3, 2)
    g, rest, s = whole(g, 6), rest.astype(np.int64), s.astype(np.int64)
    doc = np.repeat(np.arange(len(sig)), count)
    size = np.zeros(len(sig), np.int64)
    size[doc] = s
    far = _reach(threshold, s, rest)
    ok = np.flatnonzero(far >= _ceil(threshold * s))
    order = ok[np.lexsort((s[ok], g[ok]))]
    g, doc, s, far, ahead = g[order], doc[order], s[order], far[order], (s - rest)[order]
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    df = np.repeat(np.diff(np.r_[edge, len(g)]), np.diff(np.r_[edge, len(g)])) if len(g) else edge
    return (sig, size, bits, shared), g, doc, s, far, ahead, df


def _candidates(threshold: float):
    """In a fragment: pairs that share a gram of both prefixes, but no group, and pass the size and position bounds."""

    def run(table: pa.Table, groups: pa.Table | None = None) -> pa.Table:
        who, g, doc, s, far, _, df = _prefixes(table, threshold)
        sig, size = who[:2]
        label = np.full(len(sig), -1)
        if groups is not None and groups.num_rows and len(sig):
            of = groups.column("sig").to_numpy().view(np.uint64)
            order = np.argsort(of)
            at = order[np.minimum(np.searchsorted(of, sig, sorter=order), len(of) - 1)]
            _, number = np.unique(groups.column("grp").to_numpy(), return_inverse=True)
            label = np.where(of[at] == sig, number[at], -1)
        found = _Found(*who, label, threshold)
        few = (df > 1) & (df <= FEW)
        if few.any():
            _one_by_one(g[few], doc[few], s[few], far[few], threshold, found)
        if (df > FEW).any():
            _in_tiles(g[df > FEW], doc[df > FEW], size, label, threshold, found)
        return found.table()

    return run


def _outside(threshold: float):
    """As ``_candidates``, with a fragment's entities in groups."""
    run = _candidates(threshold)

    def outside(key, groups: pa.Table, table: pa.Table) -> pa.Table:
        try:
            return run(table, groups) if table.num_rows else pa.table({c: pa.array([], pa.int64()) for c in "ab"})
        finally:
            give_back()

    return outside


def _central(threshold: float):
    """In a fragment: pairs of the central entities of each gram of many, those with fewest rarer grams, with all that have it."""

    def run(table: pa.Table) -> pa.Table:
        who, g, doc, s, _, ahead, df = _prefixes(table, threshold)
        sig = who[0]
        found = _Found(*who, np.full(len(sig), -1), threshold)
        many = np.flatnonzero(df > FEW)
        many = many[np.lexsort((sig[doc[many]], ahead[many] / s[many], g[many]))]
        g, doc, s = g[many], doc[many], s[many]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        first = np.repeat(edge, np.diff(np.r_[edge, len(g)]))
        for lo in range(0, len(g), 500_000):
            x = np.arange(lo, min(lo + 500_000, len(g)))
            for k in range(CENTRAL):
                y = first[x] + k
                fit = (doc[x] != doc[y]) & (np.minimum(s[x], s[y]) >= _ceil(threshold * np.maximum(s[x], s[y])))
                found(doc[x[fit]], doc[y[fit]])
        return found.table()

    return run


def _gather(key, who: pa.Table, table: pa.Table) -> pa.Table:
    """In a fragment: the segments of entities in groups, by block."""
    out_g, out_b, out_p = [], [], []
    if who.num_rows and table.num_rows:
        sig, count, g = _entities(table, 1)
        starts, salt = np.cumsum(count) - count, K.mix(np.array([key[0].as_py() + 1], np.uint64))
        g = K.mix(whole(g, 6) ^ salt)
        of = who.column("sig").to_numpy().view(np.uint64)
        size, copies, grp, block = (who.column(c).to_numpy() for c in ("size", "copies", "grp", "block"))
        order = np.argsort(sig)
        at = order[np.minimum(np.searchsorted(sig, of, sorter=order), len(sig) - 1)]
        here = np.flatnonzero(sig[at] == of)
        here = here[np.lexsort((block[here], grp[here]))]
        new = np.flatnonzero(np.r_[True, (grp[here][1:] != grp[here][:-1]) | (block[here][1:] != block[here][:-1])]) if len(here) else here
        for lo, hi in zip(new, np.r_[new[1:], len(here)]):
            w = here[lo:hi]
            n = count[at[w]]
            out_g.append(int(grp[w[0]]))
            out_b.append(int(block[w[0]]))
            out_p.append(pack(of[w], n, size[w].astype(np.int64), copies[w], low(g[ranges(starts[at[w]], n)], 7)))
    give_back()
    return pa.table({"grp": pa.array(out_g, pa.int64()), "block": pa.array(out_b, pa.int32()), "payload": pa.array(out_p, pa.binary())})


def _inside(threshold: float):
    """In two blocks of a group: (sig, n), the documents of the other block that an entity is linked to; ``i`` = ``j``: of its own."""

    def run(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in "ij")
        sig, count, size, copies, keys = _segments(table, 5)
        at_right = np.repeat(table.column("block").to_numpy() != i, [len(unpack(v.as_buffer())[0]) for v in table.column("payload")])
        _, first, entity = np.unique(sig, return_index=True, return_inverse=True)
        order = np.argsort(at_right[first], kind="stable")  # entities of block i come first
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first = first[order]
        total, left = len(first), int((~at_right[first]).sum())
        sig, size, copies = sig[first], size[first].astype(np.float64), copies[first].astype(np.float64)
        row = np.repeat(place[entity], count)
        _, col = np.unique(whole(keys, 7), return_inverse=True)
        df = np.bincount(col)
        begin = np.r_[np.arange(0, left, TILE), np.arange(left, total, TILE)]
        end = np.minimum(begin + TILE, np.where(begin < left, left, total))
        tile = np.repeat(np.arange(len(begin)), end - begin)
        # n-grams of few entities: their pairs, ordered by tiles
        rare = np.flatnonzero((df[col] > 1) & (df[col] <= RARE))
        rare = rare[np.lexsort((row[rare], col[rare]))]
        edge = np.flatnonzero(np.r_[True, col[rare][1:] != col[rare][:-1]]) if len(rare) else rare
        n = np.repeat(np.r_[edge[1:], len(rare)], np.diff(np.r_[edge, len(rare)])).astype(np.int64) - np.arange(len(rare)) - 1
        x, y = row[rare[np.repeat(np.arange(len(rare)), n)]], row[rare[ranges(np.arange(len(rare)) + 1, n)]]
        if i != j:
            apart = (x < left) & (y >= left)
            x, y = x[apart], y[apart]
        codes, times = np.unique(x * total + y, return_counts=True)
        x, y = codes // total, codes % total
        pair = tile[x] * len(begin) + tile[y]
        by = np.argsort(pair, kind="stable")
        x, y, times, pair = x[by], y[by], times[by], pair[by]
        # all others: by tile, its columns and their entries
        often = np.flatnonzero(df[col] > RARE)
        often = often[np.argsort(row[often], kind="stable")]
        cuts = np.searchsorted(row[often], np.r_[begin, total])
        tiles = []
        for k in range(len(begin)):
            own = often[cuts[k] : cuts[k + 1]]
            tiles.append((*np.unique(col[own], return_inverse=True), row[own] - begin[k]))

        def matrix(k: int, places: np.ndarray) -> np.ndarray:
            used, local, rows = tiles[k]
            to = np.full(len(used), -1)
            to[places] = np.arange(len(places))
            c = to[local]
            m = np.zeros((end[k] - begin[k], len(places)), np.float32)
            m[rows[c >= 0], c[c >= 0]] = 1
            return m

        links = np.zeros(total)
        lefts = int((begin < left).sum())
        for a in range(lefts):
            for b in range(a, lefts) if i == j else range(lefts, len(begin)):
                both, pa_, pb = np.intersect1d(tiles[a][0], tiles[b][0], assume_unique=True, return_indices=True)
                lo, hi = np.searchsorted(pair, [a * len(begin) + b, a * len(begin) + b + 1])
                if not len(both) and lo == hi:
                    continue
                common = (matrix(a, pa_) @ matrix(b, pb).T).astype(np.float64)
                common[x[lo:hi] - begin[a], y[lo:hi] - begin[b]] += times[lo:hi]
                linked = common >= threshold * (size[begin[a] : end[a], None] + size[None, begin[b] : end[b]] - common) - _SLACK
                linked = (np.triu(linked, 1) if a == b else linked).astype(np.float64)
                links[begin[a] : end[a]] += linked @ copies[begin[b] : end[b]]
                links[begin[b] : end[b]] += copies[begin[a] : end[a]] @ linked
        some = links > 0
        return pa.table({"sig": sig[some].view(np.int64), "n": links[some].astype(np.int64)})

    return run


def _chunks(n: np.ndarray, most: int):
    """Ranges of ``n`` of which each sums up to ``most`` at most, or is one element."""
    sums = np.cumsum(n)
    lo = 0
    while lo < len(n):
        base = sums[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(sums, base + most, "right")), lo + 1)
        yield lo, hi
        lo = hi


_PART = "a long, b long, size_a int, size_b int, part int"


def _overlaps(key, pairs: pa.Table, table: pa.Table) -> pa.Table:
    """In a fragment: the partial overlap of each candidate pair."""
    empty = pa.table({c: pa.array([], pa.int64() if c in "ab" else pa.int32()) for c in ("a", "b", "size_a", "size_b", "part")})
    if not pairs.num_rows or not table.num_rows:
        return empty
    sig, count, g = _entities(table, 1)
    g = whole(g, 6)
    order = np.argsort(sig, kind="stable")
    sig, count, starts = sig[order], count[order], (np.cumsum(count) - count)[order]
    a, b = (pairs.column(c).to_numpy().view(np.uint64) for c in "ab")
    ia, ib = (np.minimum(np.searchsorted(sig, x), len(sig) - 1) for x in (a, b))
    swap = count[ia] > count[ib]
    ia, ib = np.where(swap, ib, ia), np.where(swap, ia, ib)
    doc = np.repeat(np.arange(len(sig)), count)
    salt = K.mix(np.arange(1, len(sig) + 1, dtype=np.uint64))
    keys = np.sort(g[ranges(starts, count)] ^ salt[doc])
    part = np.zeros(len(a), np.int32)
    for lo, hi in _chunks(count[ia], 1_000_000):
        at = ranges(starts[ia[lo:hi]], count[ia[lo:hi]])
        pair = np.repeat(np.arange(lo, hi), count[ia[lo:hi]])
        want = g[at] ^ salt[ib[pair]]
        hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        part[lo:hi] += np.bincount(pair[hit] - lo, minlength=hi - lo).astype(np.int32)
    some = pa.array(np.flatnonzero(part > 0))
    out = pairs.select(["a", "b", "size_a", "size_b"]).append_column("part", pa.array(part)).take(some)
    give_back()
    return out


def _counted(candidates: DataFrame, cut: DataFrame, who: DataFrame, threshold: float) -> DataFrame:
    """Those of ``candidates(a, b)`` that reach the threshold, with the sizes of both and their common n-grams, counted fragment by fragment and summed."""
    pairs = candidates
    for c in "ab":
        pairs = pairs.join(who.select(F.col("sig").alias(c), F.col("size").alias(f"size_{c}"), F.col("in_frags").alias(f"f{c}")), c)
    pairs = pairs.select("a", "b", "size_a", "size_b", "fa", "fb")
    spread = written(streamed(pairs, _spread("fa", "fb"), "frag int, a long, b long, size_a int, size_b int"), "spread")
    tasks = spread.groupBy(F.col("frag").alias("of")).agg(F.ceil(F.count("*") / PAIRS_BY_TASK).cast("int").alias("tasks")).where("tasks > 1")
    tasks = F.broadcast(written(tasks, "tasks"))  # a row for some fragments at most
    salt = F.pmod(F.xxhash64("a", "b"), F.coalesce("tasks", F.lit(1)).cast("long")).cast("int")
    left = spread.join(tasks, F.col("frag") == F.col("of"), "left").select("frag", salt.alias("task"), "a", "b", "size_a", "size_b")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))
    right = cut.where("kind = 0").join(tasks, F.col("frag") == F.col("of"), "left").select("frag", every.alias("task"), "payload")
    parts = left.groupBy("frag", "task").cogroup(right.groupBy("frag", "task")).applyInArrow(_overlaps, _PART)
    pairs = parts.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").cast("long").alias("common"))
    pairs = pairs.where(F.col("common") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("common")) - _SLACK)
    return written(pairs.select("a", "b", "common", "size_a", "size_b"), "pairs")


def _segmented(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, ranges_: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, cut, who): ``members(id, sig, size)``, the rows of ``_cut``, and ``who(sig, size, in_frags)`` of entities that may have a partner."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    base = pick(docs, id_col, text_col)
    shards = shards_for(docs)
    members = written(streamed(base, _members(n), "id long, sig long, size long"), "sets").distinct()
    # copies of a set other than the smallest id don't take part; an id of several sets stays
    first = F.min("id").over(W.partitionBy("sig"))
    spare = members.withColumn("spare", (F.col("id") > first).cast("int")).groupBy("id").agg(F.min("spare").alias("spare")).where("spare = 1").select(F.col("id").alias("__i"))
    reps = base.join(small(written(spare, "spare")), F.col("id") == F.col("__i"), "left_anti")
    packed = streamed(reps, _scatter(n, shards), "shard int, batch long, payload binary")
    home = by_shard(packed, _frequencies, "of int, batch long, payload binary")
    parts = ranges_ or max(2, -(-shards // SHARDS_BY_RANGE))
    cut = written(by_shard(home, _cut(threshold, parts), "kind int, frag int, payload binary", "batch"), "segments")
    who = streamed(cut.where("kind = 2").select("payload"), _directory, "sig long, size int, in_frags binary")
    return members, cut, written(who.groupBy("sig").agg(F.first("size").alias("size"), F.first("in_frags").alias("in_frags")), "directory")


def entity_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", ranges_: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members(id, sig, size)`` and all pairs ``(a, b, common, size_a, size_b)`` of signatures that reach the threshold."""
    members, cut, who = _segmented(docs, n, threshold, id_col, text_col, ranges_)
    candidates = by_shard(cut.where("kind = 1"), _candidates(threshold), "a long, b long", "frag").distinct()
    return members, _counted(candidates, cut, who, threshold)


def grouped_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", ranges_: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, pairs, bonds, inside): as ``entity_pairs``, but without the pairs within groups.

    ``bonds(a, b)`` are pairs, some of them of ``pairs`` too, that connect each group;
    ``inside(sig, n)`` is the number of documents of an entity's own group that it is
    linked to.  Sets of an id that has several are in no group.
    """
    members, cut, who = _segmented(docs, n, threshold, id_col, text_col, ranges_)
    central = by_shard(cut.where("kind = 1"), _central(threshold), "a long, b long", "frag").distinct()
    bonds = _counted(central, cut, who, threshold).select("a", "b")
    root = components(bonds.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    large = root.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= GROUP).select(F.col("root").alias("grp"))
    several = members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    odd = members.join(several, "id").select("sig").distinct()
    grouped = root.join(large, F.col("root") == F.col("grp")).select(F.col("node").alias("sig"), "grp").join(odd, "sig", "left_anti")
    copies = members.groupBy("sig").agg(F.count("*").alias("copies"))
    grouped = written(grouped.join(copies, "sig").join(who, "sig").select("sig", "size", "copies", "grp", "in_frags"), "groups")
    blocks = grouped.groupBy(F.col("grp").alias("of")).agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    found = grouped.join(blocks, F.col("grp") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks").cast("long")).cast("int"))
    found = found.select("sig", "size", "copies", "grp", "block", "in_frags")
    found = written(streamed(found, _spread("in_frags"), "frag int, sig long, size int, copies long, grp long, block int"), "grouped")
    candidates = found.select("frag", "sig", "grp").groupBy("frag").cogroup(cut.where("kind = 1").groupBy("frag")).applyInArrow(_outside(threshold), "a long, b long").distinct()
    pairs = _counted(candidates, cut, who, threshold)
    segments = found.groupBy("frag").cogroup(cut.where("kind = 0").select("frag", "payload").groupBy("frag")).applyInArrow(_gather, "grp long, block int, payload binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = segments.join(blocks, F.col("grp") == F.col("of")).select("grp", "block", "payload", other)
    sides = sides.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "payload")
    inside = by_shard(sides, _inside(threshold), "sig long, n long", ["grp", "i", "j"]).groupBy("sig").agg(F.sum("n").alias("n"))
    return members, pairs, bonds, inside


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", ranges_: int | None = None) -> DataFrame:
    """The join by document: ``doc_id, class_id, n_links``, one row for each id.

    ``n_links`` is the number of other documents whose word n-gram set has a Jaccard
    index of ``threshold`` or more with the document's, copies included: the row count
    of the full join around the document.  ``class_id`` is the smallest id of the
    documents that links lead to, directly or over others.  The pairs themselves are
    those of ``set_pairs``; neither grows with the square of the number of copies.

    Null and empty texts, and texts of white space, have no n-gram: no link, a class of
    their own.  A text of fewer than ``n`` words is one n-gram.  Rows without id are
    left out; equal rows count once; an id of several texts has the links of all of
    them, each other document once.  Very long texts are handled whole.  An empty
    table gives an empty result.  Ids that aren't whole numbers stand in the order of
    their hashes.
    """
    members, pairs, bonds, inside = grouped_pairs(docs, n, threshold, id_col, text_col, ranges_)
    sets = members.groupBy("id").agg(F.count("*").alias("k"))
    odd = members.join(small(written(sets.where("k > 1").select(F.col("id").alias("__i")), "several")), F.col("id") == F.col("__i")).select("id", "sig")
    odd = written(odd, "odd")  # ids of several sets
    regular = members.join(small(odd.select(F.col("id").alias("__i")).distinct()), F.col("id") == F.col("__i"), "left_anti")
    copies = regular.groupBy("sig").agg(F.count("*").alias("copies"))
    own = members.select(F.col("sig").alias("s"), F.col("sig").alias("t")).distinct()
    near = pairs.select(F.col("a").alias("s"), F.col("b").alias("t")).unionByName(pairs.select(F.col("b").alias("s"), F.col("a").alias("t"))).unionByName(own)
    per = near.join(copies.withColumnRenamed("sig", "t"), "t").select("s", "copies").unionByName(inside.select(F.col("sig").alias("s"), F.col("n").alias("copies")))
    per = per.groupBy("s").agg(F.sum("copies").alias("of_one"))
    strange = near.join(odd.select(F.col("sig").alias("t"), F.col("id").alias("z")), "t").select("s", "z").distinct()
    links = regular.join(per.withColumnRenamed("s", "sig"), "sig", "left").join(strange.groupBy("s").agg(F.count("*").alias("of_more")).withColumnRenamed("s", "sig"), "sig", "left")
    links = links.select("id", (F.coalesce("of_one", F.lit(0)) + F.coalesce("of_more", F.lit(0)) - 1).alias("n"))
    mine = odd.withColumnRenamed("sig", "s")
    reached = mine.join(near, "s").select("id", "t").distinct().join(copies.withColumnRenamed("sig", "t"), "t").groupBy("id").agg(F.sum("copies").alias("n"))
    others = mine.join(strange, "s").where("z <> id").select("id", "z").distinct().groupBy("id").agg(F.count("*").alias("n"))
    links = links.unionByName(reached.select("id", "n")).unionByName(others).groupBy("id").agg(F.sum("n").cast("long").alias("n_links"))
    out = pick(docs, id_col, text_col).select("id").distinct().join(links, "id", "left").join(_roots(members, pairs.select("a", "b").unionByName(bonds)), "id", "left")
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return named(out, docs, id_col, "doc_id", "class_id")


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", ranges_: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): ``doc_id, set_id`` and ``set_a < set_b, common, jaccard``; a set is named by its smallest id.

    Documents of one ``set_id`` have the same n-grams; two documents are a pair of the
    join if their sets are one or a pair.
    """
    members, pairs = entity_pairs(docs, n, threshold, id_col, text_col, ranges_)
    reps = members.groupBy("sig").agg(F.min("id").alias("rep"))
    a, b = reps.select(F.col("sig").alias("a"), F.col("rep").alias("x")), reps.select(F.col("sig").alias("b"), F.col("rep").alias("y"))
    jaccard = F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("jaccard")
    near = pairs.join(a, "a").join(b, "b").select(F.least("x", "y").alias("set_a"), F.greatest("x", "y").alias("set_b"), "common", jaccard)
    return named(members.join(reps, "sig").select(F.col("id").alias("doc_id"), F.col("rep").alias("set_id")), docs, id_col, "doc_id", "set_id"), named(near, docs, id_col, "set_a", "set_b")


def _roots(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root) of every document with words: the smallest id of its connected component."""
    reps = members.groupBy("sig").agg(F.min("id").alias("rep"))
    a, b = reps.select(F.col("sig").alias("a"), F.col("rep").alias("u")), reps.select(F.col("sig").alias("b"), F.col("rep").alias("v"))
    of = members.join(reps, "sig").select("id", "rep")
    several = of.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select(F.col("id").alias("u"))
    bridges = of.select(F.col("id").alias("u"), F.col("rep").alias("v")).join(several, "u")  # an id of several sets makes one class of them
    root = components(pairs.join(a, "a").join(b, "b").select("u", "v").unionByName(bridges))
    return of.join(root, F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of ``edges(u, v)``: the smallest node is the root.

    Alternating large and small stars; every round is written, so lineage stays short.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now, seen = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        near = both(now).groupBy("u").agg(F.min("v").alias("m"))
        stars = both(now).join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stars.distinct()
        low_ = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low_, "u")
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v")
        now = written(new.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, of the smallest id, of each class of ``classes``; columns as they are.

    Documents without a link stay, so do rows without id, without text or words.  Rows
    that share an id stay or go together.
    """
    (name,) = fresh(docs, "id")
    members, pairs, bonds, _ = grouped_pairs(docs, n, threshold, id_col, text_col)
    gone = _roots(members, pairs.select("a", "b").unionByName(bonds)).where("root < id").select(F.col("id").alias(name))
    return docs.join(small(written(gone, "near-duplicates")), key_of(docs, id_col) == F.col(name), "left_anti")


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """``classes`` in DuckDB's SQL, by a plain self-join of all documents' n-gram sets."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS gram FROM w WHERE len(ws) > 0),
    s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY 1),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    p AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE common >= {threshold} * (x.size + y.size - common) - 1e-9),
    c AS (SELECT DISTINCT doc_id, doc_id AS reached FROM documents WHERE doc_id IS NOT NULL UNION SELECT c.doc_id, p.b FROM c JOIN p ON c.reached = p.a),
    l AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
    SELECT doc_id, min(reached) AS class_id, coalesce(any_value(n), 0) AS n_links FROM c LEFT JOIN l ON a = doc_id GROUP BY 1
    """

"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of an Arrow string column as one
``uint8`` array, so that a slice of many documents costs a handful of NumPy
passes and no Python loop over rows.

A *word* is a maximal run of bytes other than ASCII white space (space, tab,
line feed, vertical tab, form feed, carriage return), case-sensitive; words
never cross documents.  Null text counts as empty: no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one NumPy pass; larger only for a single longer document.
SLICE_BYTES = 1 << 21
#: Bytes hashed at once, so that 8-byte temporaries stay small for very long documents.
SPAN = 1 << 17

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for ``i`` in ``0..n-1``."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have[0]) < n:
        size = max(n, SPAN + 1)
        inverse = np.uint64(pow(key, -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= SPAN + 1:
            _POWERS[key] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and ``n + 1`` word offsets by document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0], edge[1:] = True, ~word[:-1]
    filled = offsets[1:] > offsets[:-1]
    edge[offsets[:-1][filled]] = True
    starts = np.flatnonzero(word & edge)
    edge[-1], edge[:-1] = True, ~word[1:]
    edge[offsets[1:][filled] - 1] = True
    ends = np.flatnonzero(word & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from polynomial prefix sums modulo 2**64."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = max(int(np.searchsorted(ends, at + SPAN, "right")), lo + 1)
        n = int(ends[hi - 1]) - at
        up, down = powers(_P, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at : at + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and ``n + 1`` word offsets by document."""
    starts, ends, firsts = spans(data, offsets)
    return hash_spans(data, starts, ends), firsts


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive values, ``len(h) - n + 1`` of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    lo = 0
    while lo < len(out):
        hi = min(lo + SPAN - n, len(out)) if SPAN > 2 * n else len(out)
        m = hi - lo + n - 1
        up, down = powers(_Q, m + 1)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(h[lo : lo + m] * up[:m], out=sums[1:])
        out[lo:hi] = (sums[n:] - sums[: m + 1 - n]) * down[: hi - lo]
        lo = hi
    return mix(out)


def windows(h: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes within documents: (hash, index of the window's first word)."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.zeros(len(h) + 1, np.int32)
    size = np.diff(firsts)
    has = size >= n
    np.add.at(keep, firsts[:-1][has], 1)
    np.add.at(keep, firsts[1:][has] - n + 1, -1)
    at = np.flatnonzero(np.cumsum(keep)[: len(h) - n + 1])
    return rolling(h, n)[at], at


def grams(h: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ``n``-gram hashes and their documents; a document of fewer words is one gram."""
    g, at = windows(h, firsts, n)
    size = np.diff(firsts)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for m in range(1, n):
            of = np.flatnonzero(size[short] == m)
            if len(of):
                extra[of] = rolling_at(h, firsts[:-1][short[of]], m)
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
    return g, doc


def rolling_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """As ``rolling``, at the given starts only."""
    total, power = np.zeros(len(at), np.uint64), 1
    for k in range(n):
        total += h[at + k] * np.uint64(power)
        power = power * int(_Q) & 0xFFFFFFFFFFFFFFFF
    return mix(total)


def distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, gram) pairs, ordered by document, then by gram."""
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]

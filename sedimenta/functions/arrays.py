"""NumPy kernels on Arrow buffers: code points, n-gram hashes, signatures, repeats.  A batch costs some passes over arrays, no loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:  # CPython's own: a short text costs less than half of OpenSSL's time
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Characters (or tokens) of one NumPy pass; larger only for a single longer text.
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` elements each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1, lo + 1), n)
        yield lo, hi
        lo = hi


def char_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets in code points of byte offsets."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) - n + 1, np.uint64)
    for i in range(n):
        total = (total + values[i : i + len(total)].astype(np.uint64) + np.uint64(1)) * _ODD
        total ^= total >> np.uint64(29)
    return mix(total)


def spans(offsets: np.ndarray, space: np.ndarray, window: int | None, stride: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, end) of the stripped, non-empty windows of the stripped texts; one window each without ``window``."""
    size = len(space)
    after = np.full(size + 1, size)
    after[:size] = np.where(space, size, np.arange(size))
    after = np.minimum.accumulate(after[::-1])[::-1]  # first visible place from here on
    before = np.r_[0, np.maximum.accumulate(np.where(space, 0, np.arange(1, size + 1)))] if size else np.zeros(1, np.int64)  # behind the last one
    s, e = np.minimum(after[offsets[:-1]], offsets[1:]), np.maximum(before[offsets[1:]], offsets[:-1])
    e = np.maximum(s, e)
    row = np.arange(len(s))
    k = np.zeros(len(s), np.int64)
    if window is not None:
        n = -(-np.maximum(e - s - window, 0) // stride) + 1
        row = np.repeat(row, n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        s, e = np.minimum(s[row] + k * stride, e[row]), np.minimum(s[row] + k * stride + window, e[row])
        s = np.minimum(after[s], e)
        e = np.maximum(before[e], s)
    some = e > s
    return row[some], k[some], s[some], e[some]


def grouped(chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of their ``n`` values, starts of equal ones in it, key of each).

    Where gram and place fit into 64 bits, as for texts of an alphabet, they are sorted as one number.
    """
    size = len(chars) - n + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kept = np.zeros(int(chars.max()) + 1, np.uint64)
    kept[chars] = 1
    bits, place = max(1, (int(kept.sum()) - 1).bit_length()), size.bit_length()
    if n * bits + place > 64:
        g = rolling(chars, n)
        order = np.argsort(g)
        g = g[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        return order, starts, g[starts]
    code = (np.cumsum(kept) - kept)[chars]
    g = np.zeros(size, np.uint64)
    for i in range(n):
        g = (g << np.uint64(bits)) | code[i : i + size]
    g = np.sort((g << np.uint64(place)) | np.arange(size, dtype=np.uint64))
    order = (g & np.uint64((1 << place) - 1)).astype(np.int64)
    g >>= np.uint64(place)
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return order, starts, rolling(chars[order[starts][:, None] + np.arange(n)].ravel(), n)[::n]


#: Hashes of grams that a process has met, by their keys in order; forgotten when there are more than ``KEPT``.
KEPT = 1 << 20
_MET: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(text: str, n: int, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of the distinct grams at ``places``."""
    met, hashed = _MET.get(n, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    if len(met) > KEPT:
        met, hashed = met[:0], hashed[:0]
    at = np.searchsorted(met, keys)
    known = np.flatnonzero(at < len(met))
    known = known[met[at[known]] == keys[known]]
    out = np.full(len(keys), -1)
    out[known] = hashed[at[known]]
    new = np.flatnonzero(out < 0)
    if len(new):
        out[new] = np.frombuffer(b"".join([md5(text[p : p + n].encode()).digest()[:4] for p in places[new].tolist()]), ">u4")
        met, hashed = np.concatenate([met, keys[new]]), np.concatenate([hashed, out[new]])
        order = np.argsort(met)
        met, hashed = met[order], hashed[order]
    _MET[n] = met, hashed
    return out


class Minima:
    """Windows of a slice of texts, and minima of permuted hashes of their character ``n``-grams.

    A gram's hash is the first 32 bits of its MD5; every distinct gram of a slice is
    hashed once, and windows that overlap share the minima of what they have in common.
    A window of at most ``n`` characters is one gram.
    """

    def __init__(self, own: np.ndarray, offsets: np.ndarray, n: int, prime: int, window: int | None, stride: int | None):
        text = own.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = char_offsets(own, offsets)
        self.prime = prime
        self.row, self.number, s, e = spans(at, (chars == 32) | ((chars >= 9) & (chars <= 13)), window, stride)
        self.short = e - s <= n
        self.alone = np.array([int.from_bytes(md5(text[s[i] : e[i]].encode()).digest()[:4]) if self.short[i] else 0 for i in range(len(s))] if self.short.any() else np.zeros(len(s)), np.int64)
        self.h = self.of = np.zeros(0, np.int64)
        self.start, self.end = s, np.where(self.short, s, e - n + 1)
        gs, ge = self.start[~self.short], self.end[~self.short]
        if len(gs):
            order, starts, keys = grouped(chars, n)
            self.h = gram_hashes(text, n, order[starts], keys)
            self.order, self.size = order, np.diff(np.r_[starts, len(order)])
            self.of = np.empty(len(order), np.int64)
            self.of[order] = np.repeat(np.arange(len(starts)), self.size)
            cuts = np.unique(np.r_[gs, ge])
            self.pairs = np.stack([np.searchsorted(cuts, gs), np.searchsorted(cuts, ge)], 1).ravel()
            self.inner = cuts[cuts < len(order)]
            self.low = np.full(len(cuts) + 1, prime, np.uint32)

    def all(self, a: int, b: int) -> np.ndarray:
        """Of every window."""
        out = np.empty(len(self.row), np.uint32)
        if self.short.any():
            out[self.short] = (self.alone[self.short] * a + b) % self.prime
        if len(out) > self.short.sum():
            self.low[: len(self.inner)] = np.minimum.reduceat(((self.h * a + b) % self.prime).astype(np.uint32)[self.of], self.inner)
            out[~self.short] = np.minimum.reduceat(self.low, self.pairs)[::2]
        return out

    def some(self, a: np.ndarray, b: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
        """Of these windows, which come once each, by permutation."""
        size = self.end[windows] - self.start[windows]
        if 2 * size.sum() > len(self.of) > 0:
            yield from (self.all(x, y)[windows] for x, y in zip(a, b))
            return
        long = np.flatnonzero(size)
        h = np.zeros(0, np.int64)
        if len(long):
            first = np.cumsum(size[long]) - size[long]
            h = self.h[self.of[np.arange(int(size.sum())) + np.repeat(self.start[windows[long]] - first, size[long])]]
        for x, y in zip(a, b):
            out = ((self.alone[windows] * x + y) % self.prime).astype(np.uint32)
            if len(long):
                out[long] = np.minimum.reduceat((h * x + y) % self.prime, first)
            yield out


def slices(column: pa.Array, n: int, prime: int, window: int | None = None, stride: int | None = None) -> Iterator[tuple[int, Minima]]:
    """(first row, windows) of slices of a string column."""
    data, offsets = raw(column)
    for lo, hi in parts(offsets):
        m = Minima(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, prime, window, stride)
        if len(m.row):
            yield lo, m


def signatures(column: pa.Array, n: int, a: np.ndarray, b: np.ndarray, prime: int, window: int | None = None, stride: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, window numbers, signatures) of character ``n``-grams, for slices of a string column."""
    for lo, m in slices(column, n, prime, window, stride):
        sig = np.empty((len(a), len(m.row)), np.uint32)
        for j in range(len(a)):
            sig[j] = m.all(a[j], b[j])
        yield m.row + lo, m.number, sig.T


class Sought:
    """Signatures of items, and the hashes (modulo ``prime``) that their minima come from: a window with a band in common has all hashes of the band."""

    def __init__(self, sigs: np.ndarray, n_bands: int, a: np.ndarray, b: np.ndarray, prime: int):
        self.sigs, self.n_bands, self.rows, self.prime = sigs, n_bands, len(a) // n_bands, prime
        back = np.array([pow(int(x), -1, prime) for x in a])
        self.hashes, need = np.unique((sigs.astype(np.int64) - b) % prime * back % prime, return_inverse=True)
        self.need = need.reshape(-1, self.rows)  # by item and band
        self.first = np.argsort(sigs[:, :: self.rows], axis=0, kind="stable")

    def candidates(self, m: Minima) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item and band) where a window has all hashes of an item's band: its places with the rarest of them, then those that have the others too."""
        long = np.flatnonzero(~m.short)
        if not len(long):
            return
        own = m.h % self.prime
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = self.hashes[at] == own
        places = np.sort((np.repeat(at[hit], m.size[hit]) << 32) | m.order[np.repeat(hit, m.size)])
        begin = np.searchsorted(places, np.arange(len(self.hashes) + 1) << 32)
        count = np.diff(begin)[self.need]
        some = np.flatnonzero(count.min(1) > 0)
        need = np.take_along_axis(self.need[some], np.argsort(count[some], axis=1), 1)
        start, end = m.start[long], m.end[long]
        begun, ended = (np.cumsum(np.bincount(x, minlength=len(m.of) + 1)) for x in (start, end))
        for lo, hi in parts(np.r_[0, np.cumsum(count[some].min(1))]):
            each = count[some[lo:hi]].min(1)
            of = np.repeat(np.arange(lo, hi), each)
            at = places[np.arange(len(of)) + np.repeat(begin[need[lo:hi, 0]] - np.cumsum(each) + each, each)] & 0xFFFFFFFF
            each = np.maximum(begun[at] - ended[at], 0)  # windows around a place
            w = np.arange(int(each.sum())) + np.repeat(ended[at] - np.cumsum(each) + each, each)
            of = np.repeat(of, each)
            for r in range(1, self.rows):
                key = need[of, r] << 32
                at = np.searchsorted(places, key | start[w])
                has = np.flatnonzero(at < len(places))
                has = has[places[at[has]] < (key[has] | end[w[has]])]
                w, of = w[has], of[has]
            pairs = np.unique(w * len(self.need) + some[of])
            yield long[pairs // len(self.need)], pairs % len(self.need)


def equal_pairs(left: np.ndarray, right: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all equal pairs; ``order`` sorts ``right``."""
    of = right[order]
    lo, hi = np.searchsorted(of, left), np.searchsorted(of, left, "right")
    hit = np.flatnonzero(hi > lo)
    each = hi[hit] - lo[hit]
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[hit], each)
    return np.repeat(hit, each), order[at]


def matches(column: pa.Array, sought: Sought, n: int, a: np.ndarray, b: np.ndarray, window: int | None = None, stride: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, items, share of equal minima) of windows that have all minima of a band in common with an item's signature.

    Minima are computed only of windows that have all hashes of an item's band, and a
    band's second one only where the first is the item's, and so on.
    """
    sigs, rows = sought.sigs, sought.rows
    for lo, m in slices(column, n, sought.prime, window, stride):
        w, of = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.int64),) * 2, *sought.candidates(m)]))
        item, band = of // sought.n_bands, of % sought.n_bands
        alone = np.flatnonzero(m.short)
        found = []
        for i in range(sought.n_bands):
            here = band == i
            v, own = w[here], item[here]
            if len(alone):
                x, y = equal_pairs(next(m.some(a[i * rows :], b[i * rows :], alone)), sigs[:, i * rows], sought.first[:, i])
                v, own = np.concatenate([v, alone[x]]), np.concatenate([own, y])
            for j in range(i * rows, (i + 1) * rows):
                if not len(v):
                    break
                some, back = np.unique(v, return_inverse=True)
                same = next(m.some(a[j:], b[j:], some))[back] == sigs[own, j]
                v, own = v[same], own[same]
            found.append(v * len(sigs) + own)
        pairs = np.unique(np.concatenate(found))
        w, item = pairs // len(sigs), pairs % len(sigs)
        equal = np.zeros(len(w), np.int64)
        if len(w):
            some, back = np.unique(w, return_inverse=True)
            for j, v in enumerate(m.some(a, b, some)):
                equal += v[back] == sigs[item, j]
        yield m.row[w] + lo, item, equal / len(a)


def unit_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors of length one as doubles), for rows of equal size; missing ones have size 0, what has no direction isn't a number."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        row = np.flatnonzero(size == n)
        v = flat[start[row][:, None] + np.arange(n)]
        with np.errstate(invalid="ignore", divide="ignore"):
            yield row, v / np.sqrt((v * v).sum(1, keepdims=True))


def highest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value to six places) of at least the ``k`` highest of each row and of all that tie with them; none is minus infinity.

    The k-th highest of the maxima of groups of columns is a lower bound, above which few places are left.
    """
    sims[np.isnan(sims)] = -np.inf
    n, m = sims.shape
    least = np.full(n, -np.inf)
    if m > k:
        each = max(1, m // (8 * k))
        tops = sims[:, : m // each * each].reshape(n, -1, each).max(2)
        least = np.partition(tops, -k, axis=1)[:, -k] - 2e-6
    row, col = np.nonzero(sims >= least[:, None])
    value = sims[row, col]
    return row, col, np.copysign(np.floor(np.abs(value) * 1e6 + 0.5) / 1e6, value)


WORD, MARK, SPACE = 1, 2, 3
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """By code point: of a word, another visible character, or white space (Unicode); made once a process."""
    if not _KINDS:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        out = np.full(0x110000, MARK, np.uint8)
        for kind, pattern in ((WORD, r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _KINDS.append(out)
    return _KINDS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and ``n + 1`` offsets."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]


def tokens(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of runs of word characters and of every other visible one, and ``n + 1`` token offsets by text."""
    kind = kinds()[chars]
    edge = np.ones(len(chars) + 1, bool)
    edge[1:-1] = (kind[1:] != WORD) | (kind[:-1] != WORD)
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] != SPACE if len(starts) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()), _ODD)])
    terms = mix(chars[at + np.repeat(starts, size)].astype(np.uint64)) * power[at]
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of what ASCII white space separates in UTF-8 bytes, and ``n + 1`` word offsets by text."""
    seen = np.zeros(len(data) + 2, bool)
    seen[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text ends its words
    starts = np.flatnonzero(seen[1:] & (~seen[:-1] | edge))
    ends = np.flatnonzero(seen[:-1] & (~seen[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the word ``n``-grams of texts in UTF-8; fewer words are one shingle, and none without words."""
    starts, ends, firsts = words(data, offsets)
    h = hashes(data, starts, ends)
    size = np.diff(firsts)
    row = np.repeat(np.arange(len(size)), size)
    g = rolling(h, n)
    few = np.flatnonzero((size > 0) & (size < n))
    return np.concatenate([g[row[: len(g)] == row[n - 1 :]] if len(g) else g, hashes(h, firsts[few], firsts[few + 1])])


def distinct(h: np.ndarray) -> np.ndarray:
    """In order, each once."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def most_frequent(h: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """By row: how often its most frequent ``n``-gram occurs; 0 without one."""
    size = np.diff(offsets)
    best = np.zeros(len(size), np.int64)
    g = rolling(h, n)
    row = np.repeat(np.arange(len(size)), size)
    if not len(g):
        return best
    inside = np.flatnonzero(row[: len(g)] == row[n - 1 :])
    g, row = g[inside], row[inside]
    if not len(g):
        return best
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (row[1:] != row[:-1])])
    np.maximum.at(best, row[new], np.diff(np.r_[new, len(g)]))
    return best

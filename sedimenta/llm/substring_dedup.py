"""Substring dedup with fixed-block anchors (operator 2).

Every document is cut into non-overlapping blocks of ``(min_words + 1) // 2``
words, the reference blocks.  Every rolling window of that many words, of every
document, probes them: windows and blocks meet in the shard of their hash.  Any
repeat of ``min_words`` words holds a whole block of each document that it is in,
so none is missed.  From the anchors, hits are extended window by window along
the documents: ``min_words`` words are a repeat if the two windows that cover
them agree with those of another document, and runs of repeats that the same
documents share are joined to maximal spans.

Windows meet by 32 bits of their hash beside the shard, two windows to a repeat
(over 66 bits), and repeats once more by 48 bits beside the shard.  Nothing is
compared by pairs: a passage of ten thousand documents costs what ten thousand
windows cost, and there is no cap.

Every window travels once to its shard: the block index of a corpus can't be sent to
the tasks (it grows with the corpus), so the windows go to the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_name, by_shard, decode, encode, low, named, pack, pick, shards_for, streamed, unpack, whole

#: Bytes of a window's hash that travel, beside the shard.
WIDTH = 4

MIN_WORDS = 50
SHARD_BYTES = 12 << 20


def _group(shard: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, tags: np.ndarray, shards: int, columns: list[np.ndarray], widths: list[int]) -> tuple[list[int], list[bytes]]:
    """Packs rows (ordered by document, then position) by shard: ids, tags, counts, position gaps, columns."""
    order = by_name(shard, shards)
    shard, doc, at = shard[order], doc[order], at[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    columns = [c[order] for c in columns]
    out_s, out_p = [], []
    for s in np.flatnonzero(np.diff(edges)):
        a, b = edges[s], edges[s + 1]
        d = doc[a:b]
        new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        gaps = np.diff(at[a:b], prepend=0)
        gaps[new] = at[a:b][new]
        who = d[new]
        out_s.append(int(s))
        out_p.append(pack(ids[who], tags[who], np.diff(np.r_[new, b - a]).astype(np.uint32), encode(gaps, shards > 128), *(low(c[a:b], w) if w else c[a:b] for c, w in zip(columns, widths))))
    return out_s, out_p


def _ungroup(payloads, widths: list[int]):
    """Rows of packed values: (id, tag, position, columns), in the order of the values."""
    ids, tags, ats, columns = [], [], [], [[] for _ in widths]
    for v in payloads:
        i, t, n, gaps, *cols = unpack(v.as_buffer())
        n = n.astype(np.int64)
        gaps = decode(gaps)
        sums = np.cumsum(gaps)
        first = np.cumsum(n) - n
        base = sums[first] - gaps[first]
        ats.append(sums - np.repeat(base, n))
        ids.append(np.repeat(i, n))
        tags.append(np.repeat(t, n))
        for k, w in enumerate(widths):
            columns[k].append(whole(cols[k], w) if w else cols[k])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(ids), cat(tags), cat(ats), [cat(c) for c in columns]


def _table(key: str, out_s: list[int], out_p: list[bytes], **more) -> pa.Table:
    return pa.table({key: pa.array(out_s, pa.int32()), **{k: pa.array(v, pa.int32()) for k, v in more.items()}, "payload": pa.array(out_p, pa.binary())})


def _probe(block: int, shards: int):
    """(id, text) to all rolling windows by shard."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple] = []
            size = 0

            def flush(held=held):
                h, doc, at = (np.concatenate([p[i] for p in held]) for i in range(3))
                who, tags = (np.concatenate([p[i] for p in held]) for i in (3, 4))
                s, p = _group((h >> np.uint64(40)) % np.uint64(shards), doc, at, who, tags, shards, [h], [WIDTH])
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(p, pa.binary())], ["shard", "payload"])

            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                h, firsts = K.words(data[o[0] : o[-1]], o - o[0])
                w, at = K.windows(h, firsts, block)
                if not len(w):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.maximum(np.diff(firsts) - block + 1, 0))
                sums = np.r_[np.uint64(0), np.cumsum(h * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))]
                tag = sums[firsts[1:]] - sums[firsts[:-1]]
                tag = K.mix(tag - np.uint64(2) * firsts[:-1].astype(np.uint64) * (_sum(h, firsts))).astype(np.uint32)
                base = sum(len(p[3]) for p in held)
                held.append((w, doc + base, at - firsts[doc], ids[lo:hi], tag))
                size += len(w)
                if size > 1_000_000:
                    yield flush()
                    size = 0
            if held:
                yield flush()

    return run


def _sum(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.r_[np.uint64(0), np.cumsum(h)]
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _shared(h: np.ndarray, ids: np.ndarray):
    """For rows ordered by (hash, id): group of each row, and whether the group has two ids."""
    new = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(new) - 1
    edge = np.flatnonzero(new)
    last = np.r_[edge[1:], len(h)] - 1
    return group, edge, last, (ids[edge] != ids[last])[group]


def _anchors(block: int, homes: int):
    """In a shard: windows that another document has too; marked where the two meet on a reference block."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, tags, at, (h,) = _ungroup(table.column("payload"), [WIDTH])
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.r_[False, s[1:] == s[:-1]]
        order = order[same | np.r_[same[1:], False]]  # windows of a hash that is there once are done with
        ids, tags, at, h = ids[order], tags[order], at[order], h[order]
        if not len(h):
            return _table("home", [], [], of=[])
        order = np.lexsort((at, tags, ids, h))
        ids, tags, at, h = ids[order], tags[order], at[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (at[1:] != at[:-1])]
        ids, tags, at, h = ids[new], tags[new], at[new], h[new]
        group, edge, _, ok = _shared(h, ids)
        anchor = np.add.reduceat((at % block == 0).astype(np.int64), edge)[group] > 0
        ids, tags, at, h, anchor = ids[ok], tags[ok], at[ok], h[ok], anchor[ok]
        order = np.lexsort((at, tags, ids))
        ids, tags, at, h, anchor = ids[order], tags[order], at[order], h[order], anchor[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])] if len(ids) else np.zeros(0, bool)
        doc = np.cumsum(new) - 1
        home = (K.mix(ids[new].view(np.uint64)) >> np.uint64(20)) % np.uint64(homes)
        # the anchor's mark takes the place of the 41st bit
        out_s, out_p = _group(home[doc], doc, at, ids[new], tags[new], homes, [h | (anchor.astype(np.uint64) << np.uint64(40))], [6])
        return _table("home", out_s, out_p, of=[shard] * len(out_s))

    return run


def _extend(words: int, block: int, shards: int):
    """At home: ``words`` words whose windows are all shared and hold an anchor, by shard of their joint hash."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_ungroup([p], [6]) + (of,) for of, p in zip(table.column("of").to_pylist(), table.column("payload"))]
        ids, tags, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        h = np.concatenate([p[3][0] | (np.uint64(p[4]) << np.uint64(41)) for p in parts])
        order = np.lexsort((at, tags, ids))
        ids, tags, at, h = ids[order], tags[order], at[order], h[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
        doc = np.cumsum(new) - 1
        step = words - block
        n = len(at) - step
        if n <= 0:
            return _table("shard", [], [])
        anchors = np.r_[0, np.cumsum((h >> np.uint64(40)) & np.uint64(1))]
        i = np.flatnonzero((doc[step:] == doc[:n]) & (at[step:] - at[:n] == step) & (anchors[step + 1 :] > anchors[:n]))
        bare = h & ~np.uint64(1 << 40)
        joint = K.mix(K.mix(bare[i]) * np.uint64(3) + bare[i + step])
        out_s, out_p = _group((joint >> np.uint64(40)) % np.uint64(shards), doc[i], at[i], ids[new], tags[new], shards, [joint], [6])
        return _table("shard", out_s, out_p)

    return run


def _confirm(homes: int):
    """In a shard: repeats that two documents have; the documents (number, a hash of the set), the smallest other id, and where the smallest has it."""

    def run(table: pa.Table) -> pa.Table:
        ids, tags, at, (h,) = _ungroup(table.column("payload"), [6])
        order = np.lexsort((at, tags, ids, h))
        ids, tags, at, h = ids[order], tags[order], at[order], h[order]
        group, edge, last, ok = _shared(h, ids)
        first_of = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]
        docs = np.add.reduceat(first_of.astype(np.int64), edge)
        whole_set = K.mix(np.add.reduceat(np.where(first_of, K.mix(ids.view(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)), np.uint64(0)), edge))
        least = ids[edge]
        start = np.minimum.reduceat(np.where(ids == least[group], at, np.iinfo(np.int64).max), edge)
        # the second smallest id of a group: the first row of the group whose id differs from the least
        other = np.flatnonzero(first_of & (ids != least[group]))
        second = least.copy()
        second[group[other][::-1]] = ids[other][::-1]
        partner = np.where(ids == least[group], second[group], least[group])
        n = np.minimum(docs[group], 2**32 - 1).astype(np.uint32)
        ids, tags, at, partner, n, of, start = ids[ok], tags[ok], at[ok], partner[ok], n[ok], whole_set[group][ok], start[group][ok]
        if not len(ids):
            return _table("home", [], [])
        order = np.lexsort((at, tags, ids))
        ids, tags, at, partner, n, of, start = (x[order] for x in (ids, tags, at, partner, n, of, start))
        new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
        doc = np.cumsum(new) - 1
        home = (K.mix(ids[new].view(np.uint64)) >> np.uint64(20)) % np.uint64(homes)
        return _table("home", *_group(home[doc], doc, at, ids[new], tags[new], homes, [partner, n, of, start.astype(np.uint32)], [0, 0, 5, 0]))

    return run


def _join(words: int):
    """At home: consecutive repeats of the same documents to maximal spans."""

    def run(table: pa.Table) -> pa.Table:
        ids, tags, at, (partner, n, of, start) = _ungroup(table.column("payload"), [0, 0, 5, 0])
        order = np.lexsort((at, tags, ids))
        ids, tags, at, partner, n, of, start = (x[order] for x in (ids, tags, at, partner, n, of, start))
        new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]
        edge = np.flatnonzero(new)
        last = np.r_[edge[1:], len(at)] - 1
        return pa.table({"doc_id": ids[edge], "start_word": at[edge], "n_words": at[last] - at[edge] + words, "n_docs": n[edge].astype(np.int64), "partner_id": partner[edge], "passage_start": start[edge].astype(np.int64)})

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal spans of words that other documents repeat word by word.

    Returns ``doc_id, start_word, n_words, n_docs, partner_id, passage_start``: every
    window of ``min_words`` words of the span occurs in the same ``n_docs`` documents,
    and the window before and the one behind it don't; where documents begin or cease
    to share, another span begins.  ``partner_id`` is the smallest other id of them,
    ``passage_start`` where the smallest of all has the span's first window: the
    documents of one passage agree in it and in the smaller of ``doc_id`` and
    ``partner_id``.  Words count from 0.

    Null, empty and shorter texts have no span.  Rows without id are left out.  Equal
    rows count once; rows of one id with different texts each get their spans, and
    what only they share is no repeat.  Repeats within one document are none.  Very
    long texts are handled whole; an empty table gives an empty result.  Ids that aren't
    whole numbers stand in the order of their hashes.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    block = (min_words + 1) // 2
    shards = shards_for(docs, SHARD_BYTES)
    base = pick(docs, id_col, text_col)
    probes = streamed(base, _probe(block, shards), "shard int, payload binary")
    hits = by_shard(probes, _anchors(block, shards), "home int, of int, payload binary")
    longer = by_shard(hits, _extend(min_words, block, shards), "shard int, payload binary", "home")
    sure = by_shard(longer, _confirm(shards), "home int, payload binary")
    found = by_shard(sure, _join(min_words), "doc_id long, start_word long, n_words long, n_docs long, partner_id long, passage_start long", "home")
    return named(found, docs, id_col, "doc_id", "partner_id")


def oracle(min_words: int = MIN_WORDS) -> str:
    """The same result in DuckDB's SQL, by grouping every window of ``min_words`` words."""
    return f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    v AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + {min_words}], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(0, greatest(len(ws) - {min_words} + 1, 0))) AS i)),
    g AS (SELECT h, count(DISTINCT doc_id) AS n, min(doc_id) AS least, min(i) FILTER (first) AS start, md5(string_agg(DISTINCT doc_id::varchar, ',' ORDER BY doc_id::varchar)) AS docs
          FROM (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY h) AS first FROM v) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
    o AS (SELECT v.h, min(doc_id) AS second FROM v JOIN g ON v.h = g.h AND v.doc_id <> g.least GROUP BY 1),
    r AS (SELECT doc_id, i, n, start, docs, CASE WHEN doc_id = least THEN second ELSE least END AS partner, i - row_number() OVER (PARTITION BY doc_id, docs ORDER BY i) AS island
          FROM v JOIN g USING (h) JOIN o USING (h))
    SELECT doc_id, min(i) AS start_word, max(i) - min(i) + {min_words} AS n_words, max(n) AS n_docs, arg_min(partner, i) AS partner_id, arg_min(start, i) AS passage_start FROM r GROUP BY doc_id, docs, island
    """

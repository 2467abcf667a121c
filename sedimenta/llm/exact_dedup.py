"""Exact dedup with composable polynomial fingerprints (operator 8).

A text's fingerprint is the value of the polynomial whose coefficients are its
UTF-8 bytes, at two fixed points, each modulo a prime of 31 bits, with its length.
Fingerprints compose: ``H(ab) = H(a) + x**len(a) * H(b)``.  So a huge document is
cut into chunks that are hashed in parallel, each shifted by its offset, and their
sum is the fingerprint of the whole.  Texts of equal fingerprint are then compared
chunk by chunk with the first of their group; what differs (a collision) is
grouped by its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import fresh, key_of, named, pick, small, streamed, written

#: (modulus, point) pairs; tests use small moduli to force collisions.
MODULI = ((2147483647, 1103515245), (2147483629, 1812433253))
CHUNK_BYTES = 1 << 20
COPIES_PER_SALT = 256


def _table(p: int, x: int, n: int) -> np.ndarray:
    """x**i modulo p for i below n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, power = 1, x % p
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(power) % np.uint64(p)
        have += more
        power = power * power % p
    return out


def fingerprint(data: np.ndarray, offsets: np.ndarray, p: int, x: int) -> np.ndarray:
    """Fingerprint of each document of a buffer, modulo ``p`` at ``x``."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    if int(size.max()) > K.SPAN:  # long ones chunk by chunk, shifted by the length before
        longer = size > K.SPAN
        for i in np.flatnonzero(longer):
            total, shift = 0, 1
            for at in range(int(offsets[i]), int(offsets[i + 1]), K.SPAN):
                end = min(at + K.SPAN, int(offsets[i + 1]))
                part = int(fingerprint(data[at:end], np.array([0, end - at]), p, x)[0])
                total = (total + shift * part) % p
                shift = shift * pow(x, end - at, p) % p
            out[i] = total
        cuts = np.flatnonzero(np.diff(np.r_[True, longer, True]))  # runs of the others
        for a, b in zip(cuts[::2], cuts[1::2]):
            o = offsets[a : b + 1]
            out[a:b] = fingerprint(data[o[0] : o[-1]], o - o[0], p, x)
        return out
    up = _cached(p, x, int(size.max()))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    terms = (data.astype(np.uint64) + np.uint64(1)) * up[place]  # below 2**40 each, fewer than 2**20 of them
    out[some] = np.add.reduceat(terms, offsets[:-1][some]) % np.uint64(p)
    return out


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _cached(p: int, x: int, n: int) -> np.ndarray:
    have = _TABLES.get((p, x))
    if have is None or len(have) < n:
        have = _TABLES[p, x] = _table(p, x, max(n, 1 << 17))
    return have


def compose(a: int, a_bytes: int, b: int, p: int, x: int) -> int:
    """The fingerprint of a text from those of its two parts."""
    return (a + pow(x, a_bytes, p) * b) % p


def _whole(moduli):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            size = np.diff(offsets)
            prints = [[], []]
            for lo, hi in K.pieces(offsets):
                o = offsets[lo : hi + 1]
                for k, (p, x) in enumerate(moduli):
                    prints[k].append(fingerprint(data[o[0] : o[-1]], o - o[0], p, x))
            f = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in prints]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(size), pa.array(f[0]), pa.array(f[1])], ["id", "tag", "n_bytes", "f1", "f2"])

    return run


def _parts(moduli):
    """Chunks of huge texts to their share of the sum."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("chunk"))
            at = batch.column("at").to_numpy()
            cols = []
            for p, x in moduli:
                own = fingerprint(data, offsets, p, x)
                cols.append(pa.array([pow(x, int(a), p) * int(h) % p for a, h in zip(at, own)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "tag", "n_bytes", "at")), *cols], ["id", "tag", "n_bytes", "at", "f1", "f2"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, moduli=MODULI) -> DataFrame:
    """(id, tag, n_bytes, f1, f2) of each distinct (id, text); ``tag`` is a hash that tells the texts of one id apart."""
    base = pick(docs, id_col, text_col).where("text IS NOT NULL").withColumn("tag", F.xxhash64("text"))
    short = streamed(base.where(F.octet_length("text") <= chunk_bytes), _whole(moduli), "id long, tag long, n_bytes long, f1 long, f2 long")
    huge = base.where(F.octet_length("text") > chunk_bytes)
    chunks = _chunked(huge.withColumn("n_bytes", F.octet_length("text").cast("long")), chunk_bytes, "id", "tag", "n_bytes")
    parts = streamed(chunks.repartition("id", "at"), _parts(moduli), "id long, tag long, n_bytes long, at long, f1 long, f2 long")
    parts = parts.groupBy("id", "tag", "n_bytes", "at").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"))
    mod = lambda c, p: F.pmod(F.sum(c), F.lit(p)).cast("long").alias(c)
    whole = parts.groupBy("id", "tag", "n_bytes").agg(mod("f1", moduli[0][0]), mod("f2", moduli[1][0]))
    return short.unionByName(whole)


def _chunked(df: DataFrame, chunk_bytes: int, *keep: str) -> DataFrame:
    """Rows of ``chunk_bytes`` bytes of ``text``; an empty text is one empty chunk."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / chunk_bytes).cast("int"))
    exploded = df.select(*keep, F.col("text").cast("binary").alias("b"), F.explode(starts).alias("k"))
    return exploded.select(*keep, (F.col("k").cast("long") * chunk_bytes).alias("at"), F.substring("b", F.col("k") * chunk_bytes + 1, chunk_bytes).alias("chunk"))


def _copies(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, moduli) -> DataFrame:
    """(id, tag, rep): each (id, text) whose text a smaller id has too, and the smallest."""
    prints = written(fingerprints(docs, id_col, text_col, chunk_bytes, moduli), "fingerprints").distinct()
    key = ["n_bytes", "f1", "f2"]
    groups = prints.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    found = written(prints.join(groups, key).select("id", "tag", "rep", *key, F.ceil(F.col("n") / COPIES_PER_SALT).cast("int").alias("salts")), "candidates")
    texts = pick(docs, id_col, text_col).where("text IS NOT NULL").withColumn("tag", F.xxhash64("text"))
    own = texts.join(small(found), ["id", "tag"]).dropDuplicates(["id", "tag"])
    group = ["rep", *key]
    chunks = _chunked(own, chunk_bytes, "id", "tag", *group, "salts")
    first = chunks.where("id = rep").select(*group, "at", F.col("chunk").alias("of_rep"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = chunks.where("id <> rep").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int"))
    same = rest.join(first, [*group, "at", "salt"]).groupBy("id", "tag", *group).agg(F.bool_and(F.col("chunk") == F.col("of_rep")).alias("same"))
    same = written(same, "compared")
    sure = same.where("same").select("id", "tag", "rep")
    # collisions are grouped by the texts themselves
    left = texts.join(small(same.where("NOT same").select("id", "tag", *key)), ["id", "tag"]).dropDuplicates(["id", "tag"])
    again = left.select("id", "tag", F.min("id").over(W.partitionBy(*key, "text")).alias("rep")).where("id <> rep")
    return sure.unionByName(again)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, moduli=MODULI) -> DataFrame:
    """Documents whose text another document of a smaller id has too: ``doc_id, copy_of``.

    ``copy_of`` is the smallest id that has the text.  Texts compare byte by byte.
    Null texts are copies of nothing; empty texts are copies of each other.  Rows
    without id are left out, rows of one id and text count once, and an id isn't a
    copy of itself.  An empty table gives an empty result.  Ids that aren't whole
    numbers stand in the order of their hashes.
    """
    return named(_copies(docs, id_col, text_col, chunk_bytes, moduli).select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_of")), docs, id_col, "doc_id", "copy_of")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with one row of each text: one of the smallest id, its columns as they are.

    Rows without id or text stay.  Of rows that share id and text, one stays: the first
    by the other columns' hash.
    """
    i, t, n = fresh(docs, "id", "tag", "n")
    drop = written(_copies(docs, id_col, text_col, chunk_bytes, MODULI).select(F.col("id").alias(i), F.col("tag").alias(t)), "dropped")
    tags = pick(docs, id_col, text_col).where("text IS NOT NULL").select(F.col("id").alias(i), F.xxhash64("text").alias(t))
    twice = written(tags.groupBy(i, t).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n), "repeated")
    text = F.col(text_col).cast("string")
    match = (key_of(docs, id_col) == F.col(i)) & (F.xxhash64(text) == F.col(t)) & text.isNotNull()
    kept = docs.join(small(drop), match, "left_anti")
    single = kept.join(small(twice), match, "left_anti")
    rows = kept.join(small(twice), match, "left_semi")
    others = [f for f in docs.schema if f.name not in (id_col, text_col)]
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in others] or [F.lit(0)]
    plain = [F.col(f"`{f.name}`") for f in others if f.dataType.simpleString() in ("string", "bigint", "int", "double", "boolean", "date", "timestamp")]
    one = rows.withColumn(n, F.row_number().over(W.partitionBy(key_of(docs, id_col), text).orderBy(F.xxhash64(*hashed), *plain))).where(F.col(n) == 1).drop(n)
    return single.unionByName(one)


ORACLE = """
    SELECT doc_id, copy_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
    WHERE doc_id <> copy_of
"""

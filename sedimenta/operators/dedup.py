"""Duplication: exact, paragraph, n-gram, repetition within a document, MinHash, semantic."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import arrays as A
from ..functions import rules as R
from ..functions import text as T
from ..functions.graph import components, roots
from ..functions.session import gathered, written
from ..ship import ship

PRIME = 2147483647
REPETITION = {"duplicate_line_fraction": 0.30, "duplicate_paragraph_fraction": 0.30, "duplicate_line_char_fraction": 0.20, "duplicate_paragraph_char_fraction": 0.20}
TOP_NGRAMS = dict(zip(range(2, 11), (0.20, 0.18, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.10)))


def exact(docs: DataFrame, sep: str = "\n\n", min_chars: int = 50) -> DataFrame:
    """Per document: hash, copies of it, paragraphs that occur twice or more anywhere; all members are flagged."""
    d = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("doc_hash"), T.paragraphs(F.col("text"), sep, min_chars).alias("ps"))
    p = d.select("doc_id", F.explode("ps").alias("p")).select("doc_id", F.md5("p").alias("h"))
    many = p.groupBy("h").agg(F.count("*").alias("n"))  # partial counts first: a frequent paragraph is no hot key here
    dup = p.join(many, "h").groupBy(F.col("doc_id").alias("d2")).agg(F.sum((F.col("n") > 1).cast("long")).alias("dups"))
    n = F.count("*").over(W.partitionBy("doc_hash"))
    out = d.select("doc_id", "doc_hash", F.size("ps").alias("n_p"), n.alias("dup_doc_count")).join(dup, F.col("doc_id") == F.col("d2"), "left")
    dups = F.coalesce("dups", F.lit(0))
    return out.select("doc_id", "doc_hash", "dup_doc_count", dups.alias("para_dup_count"), F.when(F.col("n_p") > 0, F.round(dups / F.col("n_p"), 4)).otherwise(0.0).alias("para_dup_ratio"), (F.col("dup_doc_count") > 1).alias("is_exact_dup"), (dups > 0).alias("has_para_dups"))


def repetition(docs: DataFrame) -> DataFrame:
    """Per document: shares of repeated lines, paragraphs and n-grams, and the thresholds they pass.

    The shares are counted in one pass over Arrow batches, which the optimizer doesn't
    look into: no filter on the result computes anything twice.
    """
    ship(docs.sparkSession)
    run, names = R.repeats(tuple(TOP_NGRAMS))
    d = docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "token_count long", *(f"{c} double" for c in names)]))
    over = {**REPETITION, **{f"top_{n}gram_fraction": v for n, v in TOP_NGRAMS.items()}}
    trig = F.filter(F.array(*(F.when(F.col(k) > v, F.lit(k)) for k, v in over.items())), lambda x: x.isNotNull())
    return d.select("doc_id", "token_count", *(F.round(k, 6).alias(k) for k in over), F.array_join(trig, ",").alias("triggered_thresholds"), (F.size(trig) > 0).alias("is_high_repetition"))


#: Parts by which n-grams of paragraphs meet: a part is held in memory at a time.
SHARDS = 512
_PACK = "base long, shard int, ids array<{}>, a binary, b binary"


def _packed_grams(n: int, id_type: pa.DataType):
    """(doc_id, ps), in the order of ``doc_id``, to packs of a batch.

    ``base`` names the batch and numbers its first paragraph, in the order of documents.
    One row of shard -1 has the documents, their paragraphs (a) and the distinct n-grams
    of each (b); the others hashes of a range (a) and the batch's paragraphs they are of (b).
    """
    cuts = (np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(64 - (SHARDS - 1).bit_length())).astype(np.uint64)

    def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, firsts = A.words(data, offsets)
        size = np.diff(firsts)
        row = np.repeat(np.arange(len(size)), size)
        g = A.rolling(A.hashes(data, starts, ends), n)
        inside = np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        few = np.flatnonzero(size < n)  # a short paragraph is one gram, as it stands
        return np.concatenate([g[inside], A.hashes(data, offsets[few], offsets[few + 1])]), np.concatenate([row[inside], few])

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ps = batch.column("ps")
            count = pc.fill_null(pc.list_value_length(ps), 0).to_numpy(zero_copy_only=False).astype(np.uint32)
            data, offsets = A.raw(ps.flatten())
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for lo, hi in A.parts(offsets):
                h, p = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found.append((h, p + lo))
            h, p = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((p, h))
            h, p = h[order], p[order].astype(np.uint32)
            once = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]) if len(h) else np.zeros(0, np.int64)
            h, p = h[once], p[once]
            total = np.bincount(p, minlength=len(offsets) - 1).astype(np.uint32)
            at = np.searchsorted(h, cuts)
            rows = [(-1, batch.column("doc_id").to_pylist(), count.tobytes(), total.tobytes())]
            rows += [(i, None, x.tobytes(), y.tobytes()) for i, (x, y) in enumerate(zip(np.split(h, at), np.split(p, at))) if len(x)]
            kinds = (pa.int32(), pa.list_(id_type), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([base] * len(rows), pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], ["base", "shard", "ids", "a", "b"])
            base += max(1, len(total))

    return run


def _seen_earlier(table: pa.Table) -> pa.Table:
    """Packs of one shard to (base, a, b): by batch, its paragraphs with grams that an earlier paragraph has, and how many."""
    bases = table.column("base").to_numpy()
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()])
    own = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("b").to_pylist()]
    p = np.concatenate([x + y for x, y in zip(bases, own)])
    order = np.lexsort((p, h))
    h, p = h[order], p[order]
    later = p[np.r_[False, h[1:] == h[:-1]]]
    paragraph, count = np.unique(later, return_counts=True)
    bases = np.sort(bases)
    at = np.searchsorted(paragraph, bases)
    rows = [(x, (y - x).astype(np.uint32).tobytes(), z.astype(np.uint32).tobytes()) for x, y, z in zip(bases.tolist(), np.split(paragraph, at)[1:], np.split(count, at)[1:]) if len(y)]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("base", pa.int64()), ("a", pa.binary()), ("b", pa.binary())))})


def _overlaps(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        head = int(np.flatnonzero(shard == -1)[0])
        count, total = np.frombuffer(a[head], np.uint32).astype(np.int64), np.frombuffer(b[head], np.uint32)
        seen = np.zeros(len(total))
        for i in np.flatnonzero(shard != -1).tolist():
            seen[np.frombuffer(a[i], np.uint32)] += np.frombuffer(b[i], np.uint32)
        overlap, of = seen / np.maximum(total, 1), np.repeat(np.arange(len(count)), count)
        share = lambda x: np.bincount(of, x, len(count)) / np.maximum(count, 1)
        ids = table.column("ids").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).slice(head, 1).flatten()
        return pa.table({"doc_id": ids, "para_count": count, "ratio": share(overlap >= threshold), "mean": share(overlap)})

    return run


def ngram(docs: DataFrame, n: int = 13, threshold: float = 0.5, sep: str = "\n\n", min_chars: int = 50) -> DataFrame:
    """Per document, in the order of ``doc_id``: paragraphs whose n-grams mostly occurred in an earlier paragraph.

    N-grams (64-bit hashes) meet as packed arrays by batch and shard; what comes back is
    a number a paragraph and shard.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    ps = docs.select("doc_id", T.paragraphs(F.col("text"), sep, min_chars).alias("ps")).repartitionByRange(max(1, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id")
    packs = written(ps.mapInArrow(_packed_grams(n, to_arrow_type(id_type)), _PACK.format(id_type.simpleString())), "grams")
    seen = gathered(packs.where("shard >= 0"), "shard", SHARDS, packs.rdd.getNumPartitions()).groupBy("shard").applyInArrow(_seen_earlier, "base long, a binary, b binary")
    both = packs.where("shard = -1").unionByName(seen.withColumn("shard", F.lit(0)), allowMissingColumns=True)
    out = both.groupBy("base").applyInArrow(_overlaps(threshold), f"doc_id {id_type.simpleString()}, para_count long, ratio double, mean double")
    ratio = F.round("ratio", 4)
    return out.select("doc_id", "para_count", ratio.alias("para_contamination_ratio"), F.round("mean", 4).alias("mean_shingle_overlap"), (ratio > 0).alias("is_ngram_dup"))


#: Shingles of one piece that is hashed.
PIECE = 1 << 16


def _digests(n: int):
    """(doc_id, text) to (doc_id, is_cjk, n_shingles, shingles_md5)."""
    width, blanks = 5 * n, np.array([9, 10, 32], np.uint32)

    def digest(text: str) -> tuple[bool, int, str]:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cjk = not text.isascii() and R.cjk_share(chars) > 0.3
        if not cjk:
            ws = text.encode().split()
            grams = [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [b" ".join(ws)]
            return cjk, len(grams), hashlib.md5(b"|".join(grams)).hexdigest()
        bare = chars[~np.isin(chars, blanks)]
        if len(bare) < width:
            return cjk, 1, hashlib.md5(bare.tobytes().decode("utf-32-le").encode()).hexdigest()
        grams, found = np.lib.stride_tricks.sliding_window_view(bare, width), hashlib.md5()
        for at in range(0, len(grams), PIECE):
            part = grams[at : at + PIECE]
            flat = np.full((len(part), width + 1), ord("|"), np.uint32)
            flat[:, 1:] = part
            found.update(flat.ravel()[0 if at else 1 :].tobytes().decode("utf-32-le").encode())
        return cjk, len(grams), found.hexdigest()

    def run(batches):
        for batch in batches:
            found = [digest(t or "") for t in batch.column("text").to_pylist()]
            cols = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, (pa.bool_(), pa.int64(), pa.string())))], ["doc_id", "is_cjk", "n_shingles", "shingles_md5"])

    return run


def shingle_digests(docs: DataFrame, n: int) -> DataFrame:
    """Per document: whether it is mostly CJK, the number of its shingles (``text.any_shingles``) and the MD5 of them, joined.

    The shingles, some times the text, are made piece by piece on code points; the
    expression looks for each from the text's start on.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests(n), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, is_cjk boolean, n_shingles long, shingles_md5 string")


def permutations(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    return rng.randint(1, PRIME, k, dtype=np.int64), rng.randint(0, PRIME, k, dtype=np.int64)


def gram_hashes(text: str, n: int) -> tuple[int, bytes]:
    """How many shingles a text has (``text.any_shingles``), and the first four bytes of the MD5 of each."""
    md5, raw = A.md5, text.encode()
    chars = np.zeros(0, np.uint32) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if R.cjk_share(chars) > 0.3:
        bare, width = text.translate({9: None, 10: None, 32: None}), 5 * n
        grams = [bare[i : i + width].encode() for i in range(len(bare) - width + 1)] if len(bare) >= width else [bare.encode()]
        return len(grams), b"".join([md5(g).digest()[:4] for g in grams])
    ws = raw.split()
    flat = b" ".join(ws)
    if len(ws) < n:
        return 1, md5(flat).digest()[:4]
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[: len(ws) - n] + 1]
    return len(starts), b"".join([md5(flat[s:e]).digest()[:4] for s, e in zip(starts.tolist(), ends[n - 1 :].tolist())])


#: Hashes that are permuted at once: they stay near the processor.
AT_ONCE = 1 << 16


def minima(hashes: np.ndarray, firsts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """MinHash signatures of the parts of ``hashes`` that begin at ``firsts``, none of which is empty."""
    a, b = permutations(k, seed)
    out = np.empty((len(firsts), k), np.int64)
    for lo, hi in A.parts(np.r_[firsts, len(hashes)], AT_ONCE):
        at = firsts[lo:hi]
        h = hashes[at[0] : firsts[hi] if hi < len(firsts) else len(hashes)]
        for j in range(k):
            out[lo:hi, j] = np.minimum.reduceat((h * a[j] + b[j]) % PRIME, at - at[0])
    return out


def _signatures(n: int, k: int, min_shingles: int, seed: int, legacy_sentinel: bool):
    def run(batches):
        for batch in batches:
            found = [gram_hashes(t or "", n) for t in batch.column("text").to_pylist()]
            count = np.array([c for c, _ in found], np.int64)
            enough = np.flatnonzero(count >= min_shingles)
            kept = np.arange(len(found)) if legacy_sentinel else enough
            out = np.full((len(found), k), PRIME, np.int64)
            if len(enough):
                h = np.frombuffer(b"".join([found[i][1] for i in enough.tolist()]), ">u4").astype(np.int64)
                out[enough] = minima(h, np.cumsum(count[enough]) - count[enough], k, seed)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * k + 1, k, dtype=np.int32)), pa.array(out[kept].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept)), sig], ["doc_id", "sig"])

    return run


def minhash_signatures(docs: DataFrame, n: int = 5, k: int = 64, min_shingles: int = 5, seed: int = 1, legacy_sentinel: bool = False) -> DataFrame:
    """(doc_id, sig) of documents with at least ``min_shingles`` shingles (``text.any_shingles``).

    A shingle's hash is the first 32 bits of its MD5, the same in any SQL engine.  Others
    have no signature and no pair; with ``legacy_sentinel`` they share one signature, so
    that they are copies of each other.
    """
    ship(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_signatures(n, k, min_shingles, seed, legacy_sentinel), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sig array<long>")


def bands(sigs: DataFrame, n_bands: int = 8, rows: int = 8) -> DataFrame:
    """(doc_id, band, key) of each band of the signatures."""
    keys = F.array(*(F.md5(F.array_join(F.transform(F.slice("sig", i * rows + 1, rows), lambda x: x.cast("string")), ",")) for i in range(n_bands)))
    return sigs.select("doc_id", F.posexplode(keys).alias("band", "key"))


def minhash_pairs(sigs: DataFrame, n_bands: int = 8, rows: int = 8, threshold: float = 0.8, bucket_cap: int | None = None) -> DataFrame:
    """(a, b, jaccard): pairs of a common bucket whose signatures agree in ``threshold`` of their places.

    Documents of one signature are one entity, so that copies aren't squared: each of
    them is paired with the smallest id among them, and that with the near ones.  With
    ``bucket_cap`` larger buckets make no pairs (the operator's older definition); the
    cap stands before the self-join.
    """
    if bucket_cap is None:
        return _entity_pairs(sigs, n_bands, rows, threshold)
    b = bands(sigs, n_bands, rows)
    ok = b.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, bucket_cap)).select("band", "key")
    b = b.join(ok, ["band", "key"])
    pairs = b.select("band", "key", F.col("doc_id").alias("a")).join(b.select("band", "key", F.col("doc_id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    s = sigs.select("doc_id", "sig")
    pairs = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size("sa")
    return pairs.select("a", "b", same.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _entity_pairs(sigs: DataFrame, n_bands: int, rows: int, threshold: float) -> DataFrame:
    s = written(sigs.select("doc_id", "sig", F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("h")), "signatures")
    rep = written(s.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "entities")
    pairs = minhash_pairs(rep.select(F.col("rep").alias("doc_id"), "sig"), n_bands, rows, threshold, 1 << 60)
    same = s.select("doc_id", "h").join(rep.select("h", "rep"), "h").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(same)


def minhash(docs: DataFrame, n: int = 5, n_bands: int = 8, rows: int = 8, threshold: float = 0.8, bucket_cap: int | None = 1000, min_shingles: int = 5, seed: int = 1, legacy_sentinel: bool = False) -> DataFrame:
    """Per document: best estimate, near duplicates, cluster (its smallest id) and its size.

    ``bucket_cap`` is part of the operator's definition (``near_dup_count`` counts
    pairs); None sets no cap and pairs copies with their smallest id only.
    """
    sigs = written(minhash_signatures(docs, n, n_bands * rows, min_shingles, seed, legacy_sentinel), "signatures")
    pairs = written(minhash_pairs(sigs, n_bands, rows, threshold, bucket_cap), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    near = both.groupBy(F.col("a").alias("d1")).agg(F.round(F.max("jaccard"), 4).alias("jaccard_max"), F.count("*").alias("near_dup_count"))
    root = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    df = docs.select("doc_id").join(near, F.col("doc_id") == F.col("d1"), "left").join(root, F.col("doc_id") == F.col("node"), "left")
    df = df.withColumn("cluster_id", F.coalesce("root", "doc_id"))
    sizes = df.groupBy(F.col("cluster_id").alias("c2")).agg(F.count("*").alias("cluster_size"))
    return df.join(sizes, F.col("cluster_id") == F.col("c2")).select("doc_id", F.coalesce("jaccard_max", F.lit(0.0)).alias("jaccard_max"), F.coalesce("near_dup_count", F.lit(0)).alias("near_dup_count"), "cluster_id", "cluster_size", (F.coalesce("near_dup_count", F.lit(0)) > 0).alias("is_near_dup"))


def minhash_distributed(clusters: DataFrame) -> DataFrame:
    """The four-phase view of ``minhash``'s result: no cluster is -1, near duplicates are the others of the cluster."""
    multi = F.col("cluster_size") >= 2
    return clusters.select("doc_id", F.when(multi, F.col("cluster_id")).otherwise(F.lit(-1)).alias("cluster_id"), "cluster_size", (F.col("cluster_size") - 1).alias("near_dup_count"), multi.alias("is_near_dup"), multi.alias("in_multi_cluster"))


BLOCK = 1024


def _blocks(pdfs):
    for pdf in pdfs:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at : at + BLOCK]
            if len(part):
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "vs": [v.tobytes()], "lo": [int(part["id"].min())]})


def _earlier(pdfs):
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            ia, ib = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids2, np.int64)
            va, vb = (np.frombuffer(x, np.float64).reshape(len(i), -1) for x, i in ((r.vs, ia), (r.vs2, ib)))
            sims = np.where(ib[None, :] < ia[:, None], va @ vb.T, -np.inf)
            best = np.round(sims, 9).argmax(1)
            top = sims[np.arange(len(ia)), best]
            on = np.isfinite(top)
            yield pd.DataFrame({"id": ia[on], "other": ib[best[on]], "cos": top[on]})


def semantic(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", eps: float = 0.07) -> DataFrame:
    """Per vector: its nearest earlier one; within ``1 - eps`` it joins that one's cluster.

    Blocks of vectors meet as packed rows; a block pair is one matrix product.
    """
    ship(vectors.sparkSession)
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") / norm).alias("v"))
    n = max(1, vectors.rdd.getNumPartitions())
    blocks = written(v.repartitionByRange(n, "id").sortWithinPartitions("id").mapInPandas(_blocks, "ids binary, vs binary, lo long"), "blocks")
    other = blocks.select(F.col("ids").alias("ids2"), F.col("vs").alias("vs2"), F.col("lo").alias("lo2"))
    sims = blocks.join(other, F.col("lo2") <= F.col("lo")).mapInPandas(_earlier, "id long, other long, cos double")
    best = sims.groupBy("id").agg(F.max(F.struct(F.round("cos", 9).alias("r"), (-F.col("other")).alias("o"), F.col("cos").alias("cos"))).alias("b"))
    df = written(v.select("id").join(best, "id", "left").select("id", F.coalesce("b.cos", F.lit(0.0)).alias("cos"), F.when(F.col("b.cos") >= 1 - eps, -F.col("b.o")).alias("parent")), "nearest")
    root = roots(df.select(F.col("id").alias("node"), "parent"))
    sizes = root.groupBy(F.col("root").alias("r2")).agg(F.count("*").alias("cluster_size"))
    out = df.join(root, F.col("id") == F.col("node")).join(sizes, F.col("root") == F.col("r2"))
    rep = F.col("root") == F.col("id")
    return out.select(F.col("id").alias(id_col), F.round("cos", 4).alias("max_cos"), F.col("root").alias("cluster_root"), "cluster_size", rep.alias("is_representative"), (~rep & (F.col("cluster_size") > 1)).alias("is_semantic_dup"))


def dense_clusters(clusters: DataFrame, root: str, id_col: str) -> DataFrame:
    """``clusters`` with ``cluster_index``: roots numbered from 0 in their order.

    Roots are ranked within ranges of them, and the ranges' sizes added up, so no task sees them all.
    """
    roots_ = written(clusters.select(root).distinct().repartitionByRange(root).withColumn("part", F.spark_partition_id()), "roots")
    sizes = roots_.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    index = roots_.join(F.broadcast(before), "part").select(F.col(root).alias("__root"), (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(root)) - 1).alias("cluster_index"))
    return clusters.join(index, F.col(root) == F.col("__root")).drop("__root")

"""Every operator on hostile small tables, against brute force and against SQL."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import brown_lm, chat_format, exact_dedup, kernels, mixing, ngram_jaccard, packing, quality_classifier, queries, robust_rules, substring_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, repeated ids, clashing columns."""
    rng = random.Random(5)
    a, b = words(rng, 120, 10**6), words(rng, 80, 10**6)
    texts = [a, a, a[:-3] + "zz", b, "", "", None, None, "   \n\t ", "one", "one", b + " " + a, words(rng, 60_000), "x" * 300_000, "퟿\u0000 é 中文 " + b]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, a, "en", "s0", 1), (None, None, None, None, None), (3, "another text of the same id", "de", "s1", 7), (-5, b, "de", "s1", 7)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "tag", "sig", "shard", "unit", "u2", "__i", "__t", "pi", "block", "rank", "size", "bucket", "drawn", "n", "rep"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ brute force


def tokens(t):
    return [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def gram_set(t, n):
    w = tokens(t)
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([" ".join(w)] if w else [])


def brute_pairs(rows, n, threshold):
    """All pairs of ids by every pair of texts."""
    sets = [(r["doc_id"], gram_set(r["text"], n)) for r in rows if r["doc_id"] is not None and gram_set(r["text"], n)]
    return {tuple(sorted((i, j))) for (i, s), (j, t) in itertools.combinations(sets, 2) if i != j and len(s & t) >= threshold * len(s | t) - 1e-9}


def brute_classes(rows, n, threshold):
    """doc_id to (class, links)."""
    pairs, ids = brute_pairs(rows, n, threshold), {r["doc_id"] for r in rows if r["doc_id"] is not None}
    root = {i: i for i in ids}
    while True:
        new = dict(root)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == root:
            break
        root = new
    links = Counter(x for p in pairs for x in p)
    return {i: (root[i], links[i]) for i in ids}


def brute_spans(rows, n):
    docs = {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and r["text"]}
    where = defaultdict(set)
    for d, t in docs:
        w = tokens(t)
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(d)
    place = {}
    for d, t in sorted(docs):
        w = tokens(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if d == min(where[key]):
                place[key] = min(place.get(key, i), i)
    out = []
    for d, t in docs:
        w = tokens(t)
        sets = [frozenset(where[tuple(w[i : i + n])]) for i in range(len(w) - n + 1)]
        i = 0
        while i < len(sets):
            j = i
            while j + 1 < len(sets) and sets[j + 1] == sets[i]:
                j += 1
            if len(sets[i]) > 1:
                out.append((d, i, j - i + n, len(sets[i]), min(sets[i] - {d}), place[tuple(w[i : i + n])]))
            i = j + 1
    return sorted(out)


def near_corpus(spark, seed):
    """Small vocabulary, edited copies, shared passages: many ties and near misses."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + (passage if k % 4 == 0 else []) + w[at:]))
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------------ kernels


def test_kernels_agree_with_plain_python():
    import pyarrow as pa

    texts = ["a b  c", "", None, "\tédé \n中 ", "x", " ", "a b c a b c"]
    data, offsets = kernels.buffers(pa.array(texts))
    h, firsts = kernels.words(data, offsets)
    assert [firsts[i + 1] - firsts[i] for i in range(len(texts))] == [len(tokens(t)) for t in texts]
    flat = [w for t in texts for w in tokens(t)]
    assert len({*h.tolist()}) == len({*flat}) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(i))
    g, doc = kernels.distinct(*kernels.grams(h, firsts, 2))
    assert Counter(doc.tolist()) == Counter({i: len(gram_set(t, 2)) for i, t in enumerate(texts) if gram_set(t, 2)})


def test_kernels_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    data, offsets = kernels.buffers(pa.array([words(random.Random(1), 500)]))
    whole = kernels.words(data, offsets)[0], kernels.rolling(kernels.words(data, offsets)[0], 5)
    monkeypatch.setattr(kernels, "SPAN", 64)
    again = kernels.words(data, offsets)[0]
    assert (again == whole[0]).all() and (kernels.rolling(again, 5) == whole[1]).all()


# ------------------------------------------------------------------ operators by SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


# ------------------------------------------------------------------ 1 chat


def test_chat_folds_events(spark):
    e = [
        (1, 5, 1, "delta", None, "lo"), (1, 2, 1, "start", "assistant", ""), (1, 3, 1, "delta", None, "draft"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "lo"), (1, 6, 1, "delta", None, " <|im_end|>"),
        (1, 0, 0, "start", "user", "hi"), (1, 1, 0, "edit", None, "hey"), (1, 7, 2, "start", "user", "gone"), (1, 8, 2, "delete", None, None), (2, 0, 0, "delta", None, "orphan"), (3, 0, 0, "other", None, "x"), (None, 0, 0, "start", "user", "x"), (4, None, 0, "start", "user", "x"),
    ]
    log = spark.createDataFrame(e, "conv_id long, seq long, message_id long, kind string, role string, text string").withColumn("first_seq", F.lit("clash"))
    r = {x.conv_id: (x.n_messages, x.rendered) for x in chat_format.rendered(log).collect()}
    assert r == {1: (2, "<|im_start|>user\nhey<|im_end|>\n<|im_start|>assistant\nlo < |im_end|><|im_end|>\n"), 2: (1, "<|im_start|>unknown\norphan<|im_end|>\n")}
    assert chat_format.rendered(log.limit(0)).count() == 0


def test_chat_of_very_long_texts_and_many_events(spark):
    long = "é" * 3_000_000
    e = [(1, 0, 0, "start", "user", long), (1, 1, 0, "edit", None, long + "x"), (1, 2, 1, "start", "assistant", None)] + [(1, 3 + k, 1, "delta", None, f"{k} ") for k in range(20_000)] + [(2, 0, 0, "note", "user", "no message")]
    log = spark.createDataFrame(e, "conv_id long, seq long, message_id long, kind string, role string, text string")
    (r,) = chat_format.rendered(log).collect()
    assert r.rendered == f"<|im_start|>user\n{long}x<|im_end|>\n<|im_start|>assistant\n{''.join(f'{k} ' for k in range(20_000))}<|im_end|>\n" and r.n_messages == 2


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é" * 100, words(rng, 200)])) for c in range(5) for t in range(4)] + [(None, 0, "user", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {c: "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for k, _, r, t in rows if k == c) for c in range(5)}
    assert {x.conv_id: x.rendered for x in chat_format.rendered(chat_format.event_log(conv)).collect()} == want


# ------------------------------------------------------------------ 2 spans, 7 pairs


@pytest.mark.parametrize("seed", range(2))
def test_spans_are_those_of_brute_force(spark, seed):
    d = near_corpus(spark, seed)
    for n in (6, 7):
        assert sorted(map(tuple, substring_dedup.repeated_spans(d, n).collect())) == brute_spans(d.collect(), n)


def test_spans_of_hostile_rows(hostile, empty):
    assert sorted(map(tuple, substring_dedup.repeated_spans(hostile).collect())) == brute_spans(hostile.collect(), 50)
    assert substring_dedup.repeated_spans(empty).count() == 0


def classes_of(df, *more, **named):
    got = [tuple(r) for r in ngram_jaccard.classes(df, *more, **named).collect()]
    assert len(got) == len({r[0] for r in got})
    return {i: (c, k) for i, c, k in got}


@pytest.mark.parametrize("few", [0, 24, 10**6])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, threshold, few):
    import pandas as pd

    d = near_corpus(spark, 3)
    rows = d.collect()
    base = [{"id": r.doc_id, "text": r.text} for r in rows]
    ids = {r.doc_id: gram_set(r.text, 2) for r in rows}
    if few == 24:
        assert classes_of(d, 2, threshold) == brute_classes(rows, 2, threshold)
    # the fragment's own code, in this process, with both ways to find pairs
    monkeypatch.setattr(ngram_jaccard, "FEW", few)
    monkeypatch.setattr(ngram_jaccard, "TILE", 16)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(pd.DataFrame(base)[["id", "text"]], preserve_index=False)
    members = pa.Table.from_batches(list(ngram_jaccard._members(2)([batch]))).to_pandas()
    reps = members.groupby("sig").id.min()
    keep = batch.filter(pa.array([i in set(reps) for i in batch.column("id").to_pylist()]))
    data, offsets = kernels.buffers(keep.column("text"))
    g, firsts, sig, size = ngram_jaccard._sets(data, offsets, 2)
    home = [ngram_jaccard._rows("of", [-1], [0], [ngram_jaccard.pack(sig, size.astype(np.uint32))])]
    packed = pa.Table.from_batches([ngram_jaccard._by_shard([(g, sig, size)], 4, 0)])
    for k in range(4):
        part = packed.take(pa.array([i for i, s in enumerate(packed.column("shard").to_pylist()) if s == k], pa.int64()))
        if part.num_rows:
            home.append(ngram_jaccard._frequencies(part))
    cut = ngram_jaccard._cut(threshold, 2)(pa.concat_tables(home))
    kinds, frags = cut.column("kind").to_pylist(), cut.column("frag").to_pylist()
    found = set()
    for f in {f for f, k in zip(frags, kinds) if k == 1}:
        t = ngram_jaccard._candidates(threshold)(cut.take(pa.array([i for i in range(cut.num_rows) if kinds[i] == 1 and frags[i] == f])))
        found |= set(zip(t.column("a").to_pylist(), t.column("b").to_pylist()))
    name = {int(s): i for s, i in reps.items()}
    want = {frozenset((name[a], name[b])) for a in name for b in name if a < b and len(ids[name[a]] & ids[name[b]]) >= threshold * len(ids[name[a]] | ids[name[b]]) - 1e-9}
    assert want <= {frozenset((name[a], name[b])) for a, b in found}


def test_classes_of_hostile_rows(spark, hostile, empty):
    assert classes_of(hostile) == brute_classes(hostile.collect(), 3, 0.5)
    kept = ngram_jaccard.one_of_each(hostile)
    assert kept.columns == hostile.columns and kept.where("doc_id IS NULL").count() == 2 and {r.doc_id for r in kept.collect()} >= {0, 4, 6, 8, 12}
    assert ngram_jaccard.classes(empty).count() == 0 and ngram_jaccard.one_of_each(empty).count() == 0


def test_links_of_copies_and_of_ids_of_several_texts(spark):
    rng = random.Random(8)
    a = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    near = [" ".join(a[:k] + ["z"] + a[k + 1 :]) for k in (0, 39)]
    texts = [" ".join(a)] * 9 + [near[0]] * 7 + [near[1]] * 3 + [words(rng, 30)] * 5 + [words(rng, 30)]
    rows = [(i * 7 % 25, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, near[1], "en", "s", 0), (4, words(rng, 30), "en", "s", 0), (77, texts[-1], "en", "s", 0), (77, texts[0], "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    assert classes_of(d) == brute_classes(d.collect(), 3, 0.5)
    member, pairs = ngram_jaccard.set_pairs(d)
    of = {(r.doc_id, r.set_id) for r in member.collect()}
    linked = {tuple(sorted((i, j))) for i, s in of for j, t in of if s == t and i != j}
    near = {(r.set_a, r.set_b) for r in pairs.collect()}
    linked |= {tuple(sorted((i, j))) for i, s in of for j, t in of if (s, t) in near and i != j}
    assert linked == brute_pairs(d.collect(), 3, 0.5)


def test_pairs_of_a_full_fragment_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PAIRS_BY_TASK", 20)
    d = near_corpus(spark, 5)
    assert classes_of(d, 2, 0.4) == brute_classes(d.collect(), 2, 0.4)


def edited_copies(rng, n: int, edits: int, size: int = 60) -> list[str]:
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = rng.choice(["the", "of", f"x{rng.randrange(10**6)}"])
        out.append(" ".join(w))
    return out


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    rng = random.Random(21)
    one, two = edited_copies(rng, 300, 7), edited_copies(rng, 90, 4, 30)
    texts = one + two + one[:40] + [words(rng, 20) for _ in range(30)] + [f"{one[0]} {two[0]}"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, two[3], "en", "s", 0), (len(texts), one[7], "en", "s", 0), (len(texts), words(rng, 9), "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    many, plain = [0], ngram_jaccard.written

    def counted(df, name):
        out = plain(df, name)
        many[0] += out.count() if name in ("spread", "pairs") else 0
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counted)
    got = classes_of(d)
    assert got == brute_classes(d.collect(), 3, 0.5)
    links = sum(k for _, k in got.values()) // 2
    assert links > 30_000 and many[0] < links


@pytest.mark.parametrize("tile", [512, 16])
@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_links_in_blocks_of_a_group(monkeypatch, threshold, tile):
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    import pyarrow as pa

    rng = random.Random(4)
    sets = [sorted(gram_set(t, 3)) for t in edited_copies(rng, 150, 9)]
    ids = {g: k for k, g in enumerate(sorted({g for s in sets for g in s}))}
    copies = [1 + k % 3 for k in range(len(sets))]
    sig = [(k * 7919 + 1) << 20 for k in range(len(sets))]
    block = [k % 2 for k in range(len(sets))]

    def rows(b):
        w = [k for k in range(len(sets)) if block[k] == b]
        half = lambda f: [[ids[g] for g in sets[k] if ids[g] % 2 == f] for k in w]
        return [ngram_jaccard.pack(np.array([sig[k] for k in w], np.uint64), np.array([len(x) for x in half(f)]), np.array([len(sets[k]) for k in w]), np.array([copies[k] for k in w]), ngram_jaccard.low(np.array(sum(half(f), []), np.uint64), 7)) for f in (0, 1)]

    got = {}
    for i, j in ((0, 0), (0, 1), (1, 1)):
        payloads = [(b, p) for b in sorted({i, j}) for p in rows(b)]
        t = ngram_jaccard._inside(threshold)(pa.table({"i": [i] * len(payloads), "j": [j] * len(payloads), "block": pa.array([b for b, _ in payloads], pa.int32()), "payload": pa.array([p for _, p in payloads], pa.binary())}))
        for s, n in zip(t.column("sig").to_pylist(), t.column("n").to_pylist()):
            got[s] = got.get(s, 0) + n
    near = lambda a, b: len(set(a) & set(b)) >= threshold * len(set(a) | set(b)) - 1e-9
    want = {sig[x]: sum(copies[y] for y in range(len(sets)) if x != y and near(sets[x], sets[y])) for x in range(len(sets))}
    assert got == {s: n for s, n in want.items() if n}


# ------------------------------------------------------------------ 3 language model


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(1)
    v, c = 25, 4
    cls = np.r_[rng.integers(0, c, v), c, c + 1]
    n = rng.poisson(1.0, (v + 2, v + 2))

    def counts(k):
        out = np.zeros((c + 2, c + 2))
        np.add.at(out, (k[:, None].repeat(v + 2, 1), k[None, :].repeat(v + 2, 0)), n)
        return out

    like = lambda m: sum(brown_lm._xlogx(x).sum() * s for x, s in ((m, 1), (m.sum(0), -1), (m.sum(1), -1)))
    bare = n.copy()
    np.fill_diagonal(bare, 0)
    for i in range(v):
        after, before = np.zeros((1, c + 2)), np.zeros((1, c + 2))
        np.add.at(after[0], cls, bare[i])
        np.add.at(before[0], cls, bare[:, i])
        new = brown_lm.exchange(np.array([i]), after, before, n[i : i + 1, i], cls[i : i + 1], counts(cls), c)
        best = max(like(counts(np.r_[cls[:i], k, cls[i + 1 :]])) for k in range(c))
        assert like(counts(np.r_[cls[:i], new, cls[i + 1 :]])) == pytest.approx(best)


def test_words_of_few_bigrams_move_as_one_alone(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, r, c, own = rng.integers(0, 4, 1), rng.poisson(0.8, (1, 6)), rng.poisson(0.8, (1, 6)), rng.integers(0, 3, 1)
        n = rng.poisson(2.0, (6, 6))
        n[a[0]] += r[0]
        n[:, a[0]] += c[0]
        n[a[0], a[0]] += own[0]
        got = []
        for few in (-1, 100):
            monkeypatch.setattr(brown_lm, "FEW", few)
            got.append(int(brown_lm.exchange(np.array([0]), r, c, own, a, n, 4)[0]))
        assert got[0] == got[1]


def test_moves_of_several_shards_raise_the_likelihood():
    rng = np.random.default_rng(3)
    v, c, dropped = 8, 2, 0
    for _ in range(100):
        cls = np.r_[np.arange(v) % c, c, c + 1]
        n = rng.poisson(0.7, (v + 2, v + 2))
        n[:, v + 1] = 0

        def counts(k):
            out = np.zeros((c + 2, c + 2))
            np.add.at(out, (k[:, None].repeat(v + 2, 1), k[None, :].repeat(v + 2, 0)), n)
            return out

        bare, new = n - np.diag(np.diag(n)), cls.copy()
        for i in range(v):  # a shard for each word
            after, before = np.zeros((1, c + 2)), np.zeros((1, c + 2))
            np.add.at(after[0], cls, bare[i])
            np.add.at(before[0], cls, bare[:, i])
            new[i] = brown_lm.exchange(np.array([i]), after, before, n[i : i + 1, i], cls[i : i + 1], counts(cls), c)[0]
        if (new != cls).any():
            start = brown_lm.likelihood(counts(cls))
            dropped += brown_lm.likelihood(counts(new)) <= start
            k, m = brown_lm.raised(cls, new, counts(cls), counts)
            assert brown_lm.likelihood(m) > start and (m == counts(k)).all()
    assert dropped


def test_insertion_is_the_best_of_all_classes():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n, r, c = rng.poisson(3.0, (6, 6)), rng.poisson(1.5, (1, 6)), rng.poisson(1.5, (1, 6))
        like = []
        for k in range(4):
            m = n.astype(float)
            m[k] += r[0]
            m[:, k] += c[0]
            # the neighbours' margins are the same whatever the class
            rows, cols = n.sum(1).astype(float), n.sum(0).astype(float)
            rows[k] += r.sum()
            cols[k] += c.sum()
            like.append(brown_lm._xlogx(m).sum() - brown_lm._xlogx(rows).sum() - brown_lm._xlogx(cols).sum())
        assert like[int(brown_lm.inserted(r, c, n)[0])] == pytest.approx(max(like))


def brute_scores(texts, core, classes, blend=brown_lm.BLEND):
    """Log-probabilities by dictionaries, from the core's classes alone."""
    import pyarrow as pa

    flat = Counter(w for t in texts for w in tokens(t))
    named = {w: int(core.vocab.ids(kernels.words(*kernels.buffers(pa.array([w])))[0])[0]) for w in flat}
    cls = {w: int(core.cls[i]) if i < core.vocab.size else classes for w, i in named.items()}
    rows = {}
    for w, i in named.items():
        if i == core.vocab.size and flat[w] > 1:
            after, before = np.zeros((1, classes + 2), int), np.zeros((1, classes + 2), int)
            for t in texts:
                seq = tokens(t)
                for k, x in enumerate(seq):
                    if x == w:
                        before[0, core.cls[named[seq[k - 1]]] if k else classes + 1] += 1
                        if k + 1 < len(seq):
                            after[0, core.cls[named[seq[k + 1]]]] += 1
            rows[w] = int(brown_lm.inserted(after, before, core.counts)[0])
    cls |= rows
    big, into = Counter(), Counter()
    for t in texts:
        seq = [classes + 1] + [cls[w] for w in tokens(t)]
        big.update(zip(seq, seq[1:]))
        into.update(seq[1:])
    share = {c: (into[c] + 1) / (sum(into.values()) + classes + 1) for c in range(classes + 1)}
    out = []
    for t in texts:
        lp, last = 0.0, classes + 1
        for w in tokens(t):
            c = cls[w]
            row = sum(v for (a, _), v in big.items() if a == last)
            p = blend * big[last, c] / row + (1 - blend) * share[c]
            lp += np.log(p) + np.log(flat[w] / (into[c] + (c == classes)))
            last = c
        out.append(lp)
    return out


@pytest.mark.parametrize("size", [2, 4, 1000])
def test_scores_are_those_of_brute_force(spark, size, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran", "the dog sat", "my hen"]) for _ in range(20)) for _ in range(30)] + ["", None, "zebra", "owl hen owl", " owl"]
    d = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    monkeypatch.setattr(brown_lm, "BATCH", 50)
    r = {x.doc_id: x for x in brown_lm.perplexities(d, 3, size).collect()}
    assert len(r) == len(texts) and r["id30"].perplexity is None and r["id31"].n_words == 0 and r["id30"].log_prob == 0
    core = brown_lm.trained(d.selectExpr("doc_id AS id", "text"), 4, 3, size)
    assert core.vocab.size <= min(size, 9) and (size < 1000 or core.vocab.size == 9) and len(set(core.cls[: core.vocab.size])) <= 3
    for i, lp in enumerate(brute_scores(texts, core, 3)):
        assert r[f"id{i}"].log_prob == pytest.approx(lp, abs=1e-5), i


def test_exchange_raises_the_likelihood_of_the_core(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran", "the dog sat", "my hen"]) for _ in range(20)) for _ in range(30)]
    base = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first, last = (brown_lm.trained(base, shards, 3, iterations=k).counts for shards, k in ((4, 0), (9, 6)))
    assert brown_lm.likelihood(last) > brown_lm.likelihood(first) and last.sum() == first.sum()


def test_no_word_that_occurs_twice_is_left_out_as_the_corpus_grows(spark):
    texts = ["the cat " * 800_000, "rare word", "rare word again", "rare once"]
    base = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    core = brown_lm.trained(base, 4, classes=3, core=3, iterations=1)
    assert sorted(core.vocab.counts) == [3, 800_000, 800_000]
    seq = [s for row in brown_lm.settled(base, core, 4).collect() for s in [brown_lm.unpack(bytes(row.payload))[3]]]
    assert Counter(np.concatenate(seq).tolist())[3] == 2  # again, once


def test_model_of_hostile_rows(hostile, empty):
    r = brown_lm.perplexities(hostile, classes=4).collect()
    assert len(r) == hostile.where("doc_id IS NOT NULL").count() and all(x.perplexity is None or x.perplexity >= 1 for x in r)
    assert brown_lm.perplexities(empty).count() == 0


# ------------------------------------------------------------------ 4 classifier


def test_classifier_learns_and_generalises(spark):
    rng = random.Random(6)
    good, bad, toxic = ["river", "stone", "light", "house"], ["%%%", "$$$", "###"], ["idiot", "moron"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(good) for _ in range(30)]
        q, t = int(i % 4 != 0), int(i % 5 == 0)
        if not q:
            w = [x + rng.choice(bad) for x in w]
        if t:
            w[rng.randrange(30)] = rng.choice(toxic)
        rows.append((i, " ".join(w)))
        labels.append((i, q, t))
    d, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    r = {x.doc_id: x for x in quality_classifier.classified(d, known.where("doc_id < 200")).collect()}
    assert all((r[i].quality_margin > 0) == bool(q) and r[i].is_toxic == bool(t) for i, q, t in labels[200:])


def test_dual_descent_reaches_the_primal():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 20, 6)) for _ in range(60)]
    y = np.where([3 in s or 5 in s for s in sets], 1, -1)
    r = np.ones(20)
    w, b = quality_classifier.dual_descent(sets, y, r, cost=1.0, epochs=400, tolerance=1e-7)
    c = np.where(y > 0, 30 / max((y > 0).sum(), 1), 30 / max((y < 0).sum(), 1))
    primal = lambda w, b: (w @ w + b * b) / 2 + sum(ci * max(0, 1 - yi * (w[s].sum() + b)) for s, yi, ci in zip(sets, y, c))
    best = primal(w, b)
    assert all(primal(w + rng.normal(0, 0.05, 20), b + rng.normal(0, 0.05)) >= best - 1e-3 for _ in range(200))


def brute_margins(rows, labels, head):
    """Features, ratios, descent and scores by sets and dictionaries, document by document."""
    import re

    one = lambda w: kernels.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]

    def features(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        h = [one(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)]
        two = [quality_classifier._REPEAT if a == b else kernels.mix(np.array([a * np.uint64(3) + b]))[0] for a, b in zip(h, h[1:])]
        return frozenset((int(x) >> 16) % quality_classifier.DIMS for x in h + two)

    with np.errstate(over="ignore"):
        sets = {i: features(t) for i, t in rows}
    known = sorted((i, y) for i, y in labels if y is not None and i in sets)
    pos, neg = Counter(), Counter()
    for i, y in known:
        (pos if y > 0 else neg).update(sets[i])
    d = quality_classifier.DIMS
    ratio = lambda f: np.log((pos[f] + 1) / (sum(pos.values()) + d)) - np.log((neg[f] + 1) / (sum(neg.values()) + d))
    w, bias, alpha, n = Counter(), 0.0, [0.0] * len(known), len(known)
    k = sum(y > 0 for _, y in known)
    rng = np.random.default_rng(0)
    for _ in range(quality_classifier.EPOCHS):
        worst = 0.0
        for j in rng.permutation(n):
            i, y = known[j]
            y = 1 if y > 0 else -1
            top = quality_classifier.COST * n / 2 / (k if y > 0 else n - k)
            g = y * (sum(w[f] * ratio(f) for f in sets[i]) + bias) - 1
            new = min(max(alpha[j] - g / (sum(ratio(f) ** 2 for f in sets[i]) + 1), 0.0), top)
            step, alpha[j] = new - alpha[j], new
            for f in sets[i]:
                w[f] += step * y * ratio(f)
            bias += step * y
            worst = max(worst, abs(step) / top)
        if worst < 1e-3:
            break
    return {i: sum(w[f] * ratio(f) for f in s) + bias for i, s in sets.items()}


def test_margins_are_those_of_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["River", "stone,", "bad-word", "%%", "é", "x x"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(40, ""), (41, None)]
    labels = [(i, int(rng.random() < 0.6), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(99, 1, 1)]
    d, known = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    r = {x.doc_id: x for x in quality_classifier.classified(d, known).collect()}
    for k, head in enumerate(("quality", "toxic")):
        for i, m in brute_margins(rows, [(x[0], x[1 + k]) for x in labels], head).items():
            assert r[i][f"{head}_margin"] == pytest.approx(m, abs=1e-5)
    text = quality_classifier.classified(d.selectExpr("'d' || doc_id AS doc_id", "text"), known.selectExpr("'d' || doc_id AS doc_id", "quality", "toxic")).collect()
    assert {x.doc_id for x in text} == {f"d{i}" for i, _ in rows}


def test_classifier_of_hostile_rows(spark, hostile, empty):
    known = spark.createDataFrame([(0, 1, 0), (3, 0, None), (3, None, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    r = quality_classifier.classified(hostile, known).collect()
    assert len(r) == hostile.where("doc_id IS NOT NULL").count() and all(x.toxic_margin is None and not x.is_toxic for x in r)
    none = quality_classifier.classified(hostile, known.limit(0)).collect()
    assert all(x.keep and x.quality_margin is None for x in none) and quality_classifier.classified(empty, known).count() == 0


# ------------------------------------------------------------------ 5 packing


def check_bins(rows, context):
    at = defaultdict(list)
    for r in rows:
        at[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
    for spans in at.values():
        spans.sort()
        assert spans[-1][1] <= context and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    return len(at)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(8)
    d = spark.createDataFrame([(i, int(rng.lognormvariate(5, 1.2))) for i in range(3000)], "doc_id long, t long")
    rows = packing.packed(d.withColumn("text", F.lit("")), 512, 4, tokens=F.col("t")).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert r.chunk_no * 512 + r.n_tokens <= d_of(d)[r.doc_id]
    assert got == Counter({k: v for k, v in d_of(d).items() if v})
    assert check_bins(rows, 512) <= 1.03 * sum(got.values()) / 512 + 2


_CACHE: dict = {}


def d_of(d):
    if id(d) not in _CACHE:
        _CACHE[id(d)] = {r.doc_id: r.t for r in d.collect()}
    return _CACHE[id(d)]


def test_knapsack_and_plan_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y = np.r_[0, rng.random(7)]
        config, value = packing.knapsack(y, 12)
        best = max(sum(y[list(c)]) for k in range(1, 13) for c in itertools.combinations_with_replacement(range(1, 8), k) if sum(c) <= 12)
        assert value == pytest.approx(best) and value == pytest.approx((config * y).sum()) and (config * np.arange(8)).sum() <= 12
        demand = np.r_[0, rng.integers(0, 40, 12)]
        bins, low = packing.plan(demand, 12)
        got = np.zeros(13, int)
        for c, n in bins:
            assert sum(i * a for i, a in c) <= 12
            for i, a in c:
                got[i] += a * n
        best = sum(n for _, n in packing.best_fit(demand, 12))
        assert (got == demand).all() and low - 1e-6 <= sum(n for _, n in bins) <= best


def optimum(demand, capacity):
    """The least number of bins, by exhaustion over full configurations."""
    from functools import lru_cache

    sizes = [s for s in range(len(demand) - 1, 0, -1) if demand[s]]

    def configs(left, room, k):
        if k == len(sizes):
            yield ()
            return
        for a in range(min(left[k], room // sizes[k]), -1, -1):
            for more in configs(left, room - a * sizes[k], k + 1):
                yield (a, *more)

    @lru_cache(None)
    def least(left):
        if not any(left):
            return 0
        first = next(k for k, n in enumerate(left) if n)
        return 1 + min(least(tuple(n - a for n, a in zip(left, c))) for c in configs(left, capacity, 0) if c[first])

    return least(tuple(int(demand[s]) for s in sizes))


def test_linear_program_against_the_optimum():
    rng = np.random.default_rng(4)
    gaps = []
    for _ in range(25):
        demand = np.zeros(11, np.int64)
        demand[rng.choice(np.arange(2, 11), 4, replace=False)] = rng.integers(1, 6, 4)
        best = optimum(demand, 10)
        x, low = packing.fractional(demand, 10)
        bins, bound = packing.plan(demand, 10)
        assert low <= best + 1e-6 and bound == low and best <= sum(n for _, n in bins) <= best + 1
        for i in np.flatnonzero(demand):
            assert sum(v * dict(c).get(int(i), 0) for c, v in x.items()) >= demand[i] - 1e-6
        gaps.append(sum(x.values()) / low - 1)
    assert np.mean(gaps) <= 0.05


def test_linear_program_of_the_documents_is_solved(spark, sf):
    n = [r.n for r in spark.read.parquet(f"{sf}/documents.parquet").select(mixing.token_estimate().alias("n")).collect()]
    demand = np.bincount([-(-(k % 2048) // 8) for k in n if k % 2048], minlength=257)
    full, demand[256], demand[0] = demand[256], 0, 0
    x, low = packing.fractional(demand, 256)
    assert sum(x.values()) <= (1 + packing.EPSILON) * low


def test_packed_rows_of_few_documents_take_the_least_number_of_bins(spark):
    rng = random.Random(11)
    for _ in range(3):
        t = [rng.randrange(1, 11) for _ in range(9)]
        d = spark.createDataFrame([(f"d{i}", k) for i, k in enumerate(t)], "doc_id string, t long").withColumn("text", F.lit("x"))
        rows = packing.packed(d, 10, 1, tokens=F.col("t")).collect()
        assert Counter({r.doc_id: r.n_tokens for r in rows}) == Counter({f"d{i}": k for i, k in enumerate(t)})
        assert optimum(np.bincount(t, minlength=11), 10) <= check_bins(rows, 10) <= optimum(np.bincount(t, minlength=11), 10) + 1


def test_packing_of_hostile_rows(hostile, empty):
    rows = packing.packed(hostile).collect()
    check_bins(rows, packing.CONTEXT)
    total = hostile.agg(F.sum(mixing.token_estimate())).first()[0]
    assert sum(r.n_tokens for r in rows) == total and packing.packed(empty).count() == 0


# ------------------------------------------------------------------ 6 mixing


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    pi, t = rng.random(200), rng.integers(1, 500, 200).astype(float)
    out = mixing.flight(pi, t, "a")
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(pi.sum()) and out @ t == pytest.approx(pi @ t)
    small_pi, small_t = np.array([0.2, 0.5, 0.7, 0.6]), np.array([3.0, 9.0, 4.0, 4.0])
    mean = np.mean([mixing.flight(mixing.flight(mixing.flight(small_pi, small_t, f"{k}"), small_t, f"b{k}", sizes=False), small_t, f"c{k}", False, False) for k in range(4000)], axis=0)
    assert mean == pytest.approx(small_pi, abs=0.04)


def test_targets_fill_like_water():
    t = mixing.target_tokens(np.array([100.0, 100.0, 10.0, 0.0]), np.array([1.0, 1.0, 1.0, 5.0]), 150)
    assert t.tolist() == [70, 70, 10, 0]


def test_mixture_reaches_its_targets(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, "x" * rng.randrange(4, 4000), f"s{min(i % 7, 3)}") for i in range(4000)], "doc_id long, text string, source string")
    w = {"s0": 1.0, "s1": 2.0, "s3": 1.0}
    rows = mixing.mixed(d, w, keep=0.2).collect()
    total = d.agg(F.sum(mixing.token_estimate())).first()[0]
    by = Counter()
    for r in rows:
        by[r.source] += r.n_tokens
    assert "s2" not in by and sum(by.values()) == pytest.approx(0.2 * total, abs=2500)
    for s, share in w.items():
        assert by[s] == pytest.approx(0.2 * total * share / 4, abs=2500)
    again = mixing.mixed(d, w, keep=0.2).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in again}


def brute_mix(rows, keep=mixing.KEEP, alpha=mixing.ALPHA, seed=mixing.SEED):
    """(id, source) drawn, of (id, source, tokens) of distinct ids: the phases by plain lists, in one block."""
    by = defaultdict(list)
    for i, s, t in sorted(rows):
        by[s].append((i, t))
    names = sorted(by)
    t = np.array([float(sum(x for _, x in by[s])) for s in names])
    goal = mixing.target_tokens(t, t**alpha, keep * t.sum())
    over, drawn = [], set()
    for s, a, b in zip(names, goal, t):
        pi = np.full(len(by[s]), min(1.0, a / b) if b else 1.0)
        left = [(i, n, p) for (i, n), p in zip(by[s], mixing.flight(pi, np.array([n for _, n in by[s]]), f"{seed}:block:{s}:0"))]
        drawn |= {(i, s) for i, _, p in left if p == 1}
        left = [x for x in left if 0 < x[2] < 1]
        if left:
            p = mixing.flight(np.array([x[2] for x in left]), np.array([x[1] for x in left]), f"{seed}:source:{s}:-1")
            drawn |= {(x[0], s) for x, q in zip(left, p) if q == 1}
            over += [(x[0], s, x[1], q) for x, q in zip(left, p) if 0 < q < 1]
    over.sort()
    p, n, key = np.array([x[3] for x in over]), np.array([x[2] for x in over]), f"{seed}:all::-2"
    if over:
        p = mixing.flight(mixing.flight(mixing.flight(p, n, key), n, key + ":landing", sizes=False), n, key + ":last", counts=False, sizes=False)
    return drawn | {(x[0], x[1]) for x, q in zip(over, p) if q == 1}


def test_flight_stays_in_the_null_space():
    """Each step of the walk against the constraints' null space by singular values."""
    rng = np.random.default_rng(5)
    for k in range(30):
        pi, t = rng.random(7), rng.integers(1, 9, 7).astype(float)
        out = mixing.flight(pi, t, str(k))
        a = np.stack([np.ones(7), t])
        null = np.linalg.svd(a)[2][2:]
        move = out - pi
        assert np.abs(a @ move).max() < 1e-9 and np.abs(move - null.T @ (null @ move)).max() < 1e-9 and ((out > 0) & (out < 1)).sum() <= 2


def test_mixture_is_that_of_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, f"s{rng.randrange(4)}", "x" * rng.randrange(1, 900)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute_mix([(i, s, -(-len(t) // 4)) for i, s, t in rows])
    assert {(r.doc_id, r.source) for r in mixing.mixed(d).collect()} == want
    assert {r.doc_id for r in mixing.sample(d).collect()} == {i for i, _ in want}
    assert {r.doc_id[1:] for r in mixing.mixed(d.selectExpr("'d' || doc_id AS doc_id", "source", "text")).collect()} <= {str(i) for i in range(300)}


def test_mixing_of_hostile_rows(hostile, empty):
    assert mixing.mixed(hostile, keep=1.0).count() == hostile.where("doc_id IS NOT NULL").select("doc_id").distinct().count() + 2
    s = mixing.sample(hostile, keep=0.5)
    assert s.columns == hostile.columns and mixing.sample(hostile, keep=1.0).count() == hostile.count()
    assert mixing.mixed(hostile, keep=0.0).count() >= 0 and mixing.mixed(empty).count() == 0 and mixing.sample(empty).count() == 0


# ------------------------------------------------------------------ 8 exact


def test_fingerprints_compose():
    p, x = exact_dedup.MODULI[0]
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    one = lambda d: int(exact_dedup.fingerprint(d, np.array([0, len(d)]), p, x)[0])
    assert one(data) == exact_dedup.compose(one(data[:1234]), 1234, one(data[1234:]), p, x)
    assert one(data[:9]) == sum((int(b) + 1) * pow(x, i, p) for i, b in enumerate(data[:9])) % p


@pytest.mark.parametrize("chunk, moduli", [(1 << 20, exact_dedup.MODULI), (50, exact_dedup.MODULI), (50, ((2, 1), (3, 1)))])
def test_copies_are_those_of_brute_force(hostile, chunk, moduli):
    of = defaultdict(set)
    for r in hostile.collect():
        if r.doc_id is not None and r.text is not None:
            of[r.text].add(r.doc_id)
    want = sorted((i, min(ids)) for ids in of.values() for i in ids if i != min(ids))
    assert sorted(map(tuple, exact_dedup.copies(hostile, chunk_bytes=chunk, moduli=moduli).collect())) == want


def test_one_row_of_each_text_stays(hostile, empty):
    kept = exact_dedup.deduplicated(hostile)
    rows = kept.collect()
    texts = [r.text for r in rows if r.doc_id is not None and r.text is not None]
    assert kept.columns == hostile.columns and len(texts) == len(set(texts)) == hostile.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text").distinct().count()
    assert kept.where("doc_id IS NULL OR text IS NULL").count() == hostile.where("doc_id IS NULL OR text IS NULL").count()
    assert exact_dedup.deduplicated(empty).count() == 0 and exact_dedup.copies(empty).count() == 0


# ------------------------------------------------------------------ 9 rules


def test_counts_of_a_text():
    import pyarrow as pa

    c = robust_rules.counts(*kernels.buffers(pa.array(["The the the, 12!\nA b\nA b\né", "", None])))
    got = {k: v.tolist() for k, v in c.items()}
    assert got["n_words"] == [9, 0, 0] and got["n_stutter"] == [0, 0, 0] and got["n_digit"] == [2, 0, 0] and got["n_punct"] == [2, 0, 0] and got["n_upper"] == [3, 0, 0] and got["n_wide"] == [2, 0, 0]
    assert got["n_lines"] == [4, 0, 0] and got["n_repeated"] == [1, 0, 0] and got["n_breaks"] == [3, 0, 0]


def test_estimate_withstands_a_fifth_of_bad_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(0, 1, (800, robust_rules.D)) @ np.diag(np.linspace(0.5, 2, robust_rules.D))
    bad = rng.normal(9, 0.5, (200, robust_rules.D))
    x = np.vstack([good, bad])
    v = spark.createDataFrame([("u", *map(float, r)) for r in x], "unit string, " + ", ".join(f"{c} double" for c in robust_rules.X))
    est = robust_rules.estimates(v, floor=0.0).first().asDict()
    centre = np.array([est[f"m{i}"] for i in range(robust_rules.D)])
    scatter = np.zeros((robust_rules.D, robust_rules.D))
    for i, j in robust_rules.PAIRS:
        scatter[i, j] = scatter[j, i] = est[f"p{i}_{j}"] / (1 if i == j else 2)
    scatter = np.linalg.inv(scatter)
    assert np.abs(centre - good.mean(0)).max() < 0.35 and np.abs(np.diag(scatter) / good.var(0) - 1).max() < 0.4
    far = lambda p: np.einsum("ij,jk,ik->i", p - centre, np.linalg.inv(scatter), p - centre)
    assert (far(bad) > robust_rules.chi2(1e-8, robust_rules.D)).all() and (far(good) < robust_rules.chi2(1e-8, robust_rules.D)).mean() > 0.99


def brute_rules(rows, steps=100):
    """(row number, distance, keep) of (text, lang, source), with lists and exact quantiles."""
    R = robust_rules
    vec, names = {}, {}
    stats = []
    for t, _, _ in rows:
        raw, w = (t or "").encode(), tokens(t)
        lines = [x for x in ([y for y in tokens(x)] for x in (t or "").split("\n")) if x]
        plain = lambda f: sum(1 for b in raw if b < 128 and f(chr(b)))  # noqa: B023, E731
        stats.append({
            "n_bytes": len(raw), "n_words": len(w), "word_bytes": sum(len(x.encode()) for x in w), "n_punct": plain(lambda c: 33 <= ord(c) < 127 and not c.isalnum()), "n_digit": plain(str.isdigit), "n_upper": plain(str.isupper),
            "n_wide": sum(b >= 128 for b in raw), "n_stutter": sum(a == b for a, b in zip(w, w[1:])), "n_breaks": raw.count(b"\n"), "n_lines": len(lines), "n_repeated": len(lines) - len({tuple(x) for x in lines}),
        })
    live = [k for k, s in enumerate(stats) if s["n_words"]]
    for lang in {rows[k][1] for k in live}:
        mine = [k for k in live if rows[k][1] == lang]
        total = lambda c: sum(stats[k][c] for k in mine)  # noqa: B023, E731
        for k in mine:
            x = []
            for j, (_, a, b, pseudo) in enumerate(R.RATES):
                rate = (stats[k][a] + pseudo * total(a) / max(total(b), 1)) / (stats[k][b] + pseudo)
                x.append(np.log(max(rate, 1e-6)) if j == 0 else 2 * np.arcsin(np.sqrt(min(max(rate, 0), 1))))
            vec[k] = np.array(x)
    for k in live:
        names[k] = ((rows[k][1], rows[k][2]), (rows[k][1],), ())
    at = lambda v, p: sorted(v)[max(int(np.ceil(p * len(v))) - 1, 0)]

    def fit(x, share):
        return x.mean(0), np.atleast_2d(np.cov(x.T, bias=True)) / R.central_variance(share) + np.eye(R.D) * R.FLOOR**2

    def far(x, m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    est = {}
    for g in {g for k in live for g in names[k]}:
        x = np.array([vec[k] for k in live if g in names[k]])
        m = np.array([at(x[:, j], 0.5) for j in range(R.D)])
        s = np.array([1.4826 * at(np.abs(x[:, j] - m[j]), 0.5) for j in range(R.D)])
        est[g] = (x, m, np.diag(s**2) + np.eye(R.D) * R.FLOOR**2)
    for _ in range(steps):
        new = {}
        for g, (x, m, c) in est.items():
            d = far(x, m, c)
            new[g] = (x, *fit(x[d <= at(d, R.TRUSTED)], R.TRUSTED))
        moved = max(abs(np.linalg.slogdet(new[g][2])[1] - np.linalg.slogdet(est[g][2])[1]) for g in est)
        est = new
        if moved < 1e-3:
            break
    final = {}
    for g, (x, m, c) in est.items():
        d = far(x, m, c)
        near = x[d <= max(at(d, 0.5) / R.chi2(0.5, R.D), 1.0) * R.chi2(0.025, R.D)]
        final[g] = (len(near), *fit(near, 0.975))
    out = {}
    for k in live:
        m = c = None
        for g in reversed(names[k]):
            n, gm, gc = final[g]
            w = 1.0 if m is None else n / (n + R.PSEUDO)
            m, c = (gm, gc) if m is None else (w * gm + (1 - w) * m, w * gc + (1 - w) * c)
        d = float(np.sqrt(far(vec[k][None], m, c)[0]))
        out[k] = (d, d <= np.sqrt(R.chi2(R.TAIL, R.D)))
    return {k: out.get(k, (None, False)) for k in range(len(rows))}


@pytest.mark.parametrize("seed", range(2))
def test_rules_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        w = [rng.choice(["stone", "River", "light,", "é", "house.", "7", "of"]) for _ in range(rng.randrange(1, 60))]
        if k % 11 == 0:
            w = [rng.choice(["%%%%%", "!!!", "999999", "A" * 40]) for _ in w]
        rows.append((rng.choice([" ", "\n"]).join(w), rng.choice(["en", "de", None]), rng.choice(["a", "b"]) if k % 3 else "a"))
    rows += [("", "en", "a"), (None, "en", None), (" \n ", "de", "b"), ("alone in its language", "xx", "c")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = brute_rules(rows)
    got = {r.doc_id: r for r in robust_rules.judged(d).collect()}
    assert len(got) == len(rows) and sum(not k for _, k in want.values()) > 5
    for i, (dist, keep) in want.items():
        assert got[i].keep == keep and (got[i].distance is None if dist is None else got[i].distance == pytest.approx(dist, abs=2e-3)), i


def test_rules_reject_junk_and_keep_the_rest(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = robust_rules.judged(d).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()
    kept = {x.quality: x.k for x in r}
    assert kept[1] > 0.97 and kept[0] < 0.5
    assert robust_rules.kept(d).columns == d.columns


def test_rules_of_hostile_rows(hostile, empty):
    r = robust_rules.judged(hostile).collect()
    assert len(r) == hostile.count() and all(x.distance is None and not x.keep for x in r if x.n_words == 0) and all(x.distance is not None for x in r if x.n_words)
    kept = robust_rules.kept(hostile)
    assert kept.columns == hostile.columns and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id IN (4, 6, 8)").count() == 0
    assert robust_rules.judged(empty).count() == 0 and robust_rules.kept(empty).count() == 0


# ------------------------------------------------------------------ 10 WARC


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    evil = "x\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(i, None if i == 2 else f"http://h/{i}\n", (evil * (i % 4)) + "é" * i) for i in range(30)] + [(98, "u", ""), (99, "u", None), (None, "u", "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write(p.coalesce(2), path)
    for split in (64, 1000, 1 << 24):
        r = {x.record_id: x for x in warc.read(spark, path, split).collect()}
        assert {k: bytes(x.payload).decode() for k, x in r.items()} == {f"<urn:page:{i}>": h for i, _, h in rows if i is not None and h is not None}
        assert r["<urn:page:2>"].target_uri is None and r["<urn:page:1>"].target_uri == "http://h/1%0A"


def test_warc_ends_at_damage(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cut.warc").write_bytes(good * 2 + good[:-6])
    (tmp_path / "d" / "broken.warc").write_bytes(good + b"garbage" + good)
    (tmp_path / "d" / "other.warc").write_bytes(b"x" + good)
    (tmp_path / "d" / "empty.warc").write_bytes(b"")
    r = Counter(x.path.rsplit("/", 1)[1] for x in warc.read(spark, "file://" + str(tmp_path / "d"), 40).collect())
    assert r == {"cut.warc": 2, "broken.warc": 1}
    (tmp_path / "none").mkdir()
    assert warc.read(spark, "file://" + str(tmp_path / "none")).count() == 0


def test_warc_of_long_headers_and_payloads_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, "http://h/" + "u" * (1 << 21), "x"), (2, "http://h/2", "WARC/1.0\r\n" + "y" * (3 << 20)), (2, "http://h/2", "twice"), (3, None, "")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("path", "offset", "next", "payload", "value", "start", "exit"):
        p = p.withColumn(c, F.lit("clash"))
    got = sorted((r.page_id, r.url, r.html) for r in warc.round_trip(p).collect() if r.url) + [(r.page_id, r.url, r.html) for r in warc.round_trip(p).collect() if not r.url]
    assert got == sorted(rows[:3]) + rows[3:] and warc.round_trip(p.limit(0)).count() == 0


def test_warc_reads_gzip_members(spark, tmp_path):
    import gzip

    (tmp_path / "z").mkdir()
    head = lambda n, k: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {n}\r\n\r\n".encode()
    rng = random.Random(3)
    inner = gzip.compress(head(2, 999) + b"no\r\n\r\n", compresslevel=0)
    bodies = [rng.randbytes(rng.randrange(5000)) + (inner if k % 3 == 0 else b"") for k in range(40)]
    records = [gzip.compress(head(len(b), k) + b + b"\r\n\r\n", compresslevel=0 if k % 2 else 9) for k, b in enumerate(bodies)]
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "z" / "cut.warc.gz").write_bytes(b"".join(records[:3])[:-5])
    for split in (1000, 1 << 20):
        r = warc.read(spark, "file://" + str(tmp_path / "z"), split).collect()
        assert {x.record_id: bytes(x.payload) for x in r if x.path.endswith("/a.warc.gz")} == {f"<urn:{k}>": b for k, b in enumerate(bodies)}
        assert sorted(x.record_id for x in r if x.path.endswith("/cut.warc.gz")) == ["<urn:0>", "<urn:1>"]


# ------------------------------------------------------------------ the pipeline


def test_pipeline(spark, sf, hostile):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{sf}/documents.parquet")
    docs = d
    for name, stage in c.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == d.columns and new.count() <= docs.count(), name
        docs = new
    assert c.run(spark, sf).count() > 0
    docs = hostile
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, sf), name)
    assert docs.count() > 0

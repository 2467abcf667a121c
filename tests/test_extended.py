"""What the queries with SQL don't cover: errors, drivers' files, resampling, parsers, against brute force."""

from __future__ import annotations

import ast
import glob
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import arrays, rules
from sedimenta.functions import text as T
from sedimenta.operators import cleaning, contamination, decisions, dedup, domain, merge, safety, tokenization
from sedimenta.sources import reader, sinks
from sedimenta.streaming import folds

DOCS = "doc_id long, text string, source string, url string, timestamp string, language string"


def docs(spark, *texts, language=None):
    return spark.createDataFrame([(i, t, "s", None, None, language) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- kernels


def test_signatures_are_those_of_plain_python():
    rng = random.Random(1)
    import pyarrow as pa

    texts = ["".join(rng.choice("ab é中\n ") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "", "  ", "x"]
    a, b = dedup.permutations(7)

    def plain(t):
        grams = {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t}
        h = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
        return [min((x * int(p) + int(q)) % dedup.PRIME for x in h) for p, q in zip(a, b)]

    space = " \t\n\r\x0b\f"
    for window, stride in ((None, None), (12, 6), (12, 5), (7, 9)):
        want = {}
        for i, t in enumerate(texts):
            s = (t or "").strip(space)
            ks = range(1 if window is None else -(-max(len(s) - window, 0) // stride) + 1)
            for k in ks:
                w = (s if window is None else s[k * stride : k * stride + window]).strip(space)
                if w:
                    want[i, k] = plain(w)
        got = {(int(r), int(k)): list(map(int, s)) for rows, ks, sig in arrays.signatures(pa.array(texts), 5, a, b, dedup.PRIME, window, stride) for r, k, s in zip(rows, ks, sig)}
        assert got == want


def test_tokens_are_those_of_the_expression(spark):
    texts = ["a_b c-d 12é", "中文 x́ ‌ ", "", "Don't… stop!!", "a\u00a0b\u3000c"]
    chars, at = arrays.code_points([t.lower() for t in texts])
    s, e, firsts = arrays.tokens(chars, at)
    flat = "".join(t.lower() for t in texts)
    got = [[flat[a:b] for a, b in zip(s[firsts[i] : firsts[i + 1]], e[firsts[i] : firsts[i + 1]])] for i in range(len(texts))]
    assert got == [r.t for r in docs(spark, *texts).orderBy("doc_id").select(T.pieces(F.col("text")).alias("t")).collect()]


def test_repetition_is_that_of_plain_python(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["A", "b", "c."]) for _ in range(rng.randrange(0, 6))) + rng.choice(["", "\n"]) for _ in range(12)) for _ in range(20)] + ["", None, " \n "]
    r = {x.doc_id: x for x in dedup.repetition(docs(spark, *texts)).collect()}
    import regex

    for i, t in enumerate(texts):
        t = (t or "").lower()
        tok = regex.findall(r"\w+|[^\w\s]", t)
        for n in (2, 5, 10):
            grams = [tuple(tok[k : k + n]) for k in range(len(tok) - n + 1)]
            want = 0.0 if len(tok) < 2 * n else min(1.0, (max(map(grams.count, grams)) - 1) * n / len(tok))
            assert r[i][f"top_{n}gram_fraction"] == pytest.approx(want, abs=1e-6)
        for name, cut in (("line", t.split("\n")), ("paragraph", regex.split(r"\n\s*\n", t))):
            u = [x for x in (" ".join(x.split()) for x in cut) if x]
            assert r[i][f"duplicate_{name}_fraction"] == pytest.approx((len(u) - len(set(u))) / max(len(u), 1), abs=1e-6)
            assert r[i][f"duplicate_{name}_char_fraction"] == pytest.approx((sum(map(len, u)) - sum(map(len, set(u)))) / max(sum(map(len, u)), 1), abs=1e-6)


def test_rules_of_cjk_and_of_blank_texts():
    g, c = cleaning.FILTERS["gopher_quality"], cleaning.FILTERS["c4_quality"]
    assert g("", "en") == "empty" and g("的 是 " * 40, "zh") == "avg_word_too_short" and g("这是的话 " * 60, "zh") == "not_enough_stop_words" and g("的 我们在这里的 是 " * 40, "zh") is None
    assert c("这是 一句话。那是 一句话。\n" * 3, "zh") is None and c("这是 一句话。", "zh") == "too_few_sentences" and c("We have { a thing.\n" * 6, "en") == "curly_bracket"
    assert rules.lines("a\n\n") == ["a", ""] and rules.unit_shares([b"", b" "]) == (0.0, 0.0)


def test_cjk_shingles_and_sentinel(spark):
    t = "中文文本没有空格所以按字符切分成片段"
    r = docs(spark, t, "a b c", "").orderBy("doc_id").select(T.any_shingles(F.col("text"), 2).alias("s")).collect()
    assert r[0].s == [t[i : i + 10] for i in range(len(t) - 9)] and r[1].s == ["a b", "b c"] and r[2].s == [""]
    d = docs(spark, "a b", "c d", " ".join(map(str, range(30))))
    assert dedup.minhash_signatures(d).count() == 1
    m = {x.doc_id: x for x in dedup.minhash(d, legacy_sentinel=True).collect()}
    assert m[0].near_dup_count == 1 and m[1].cluster_id == 0 and m[2].near_dup_count == 0


def test_pairs_without_a_cap(spark):
    same = " ".join(map(str, range(40)))
    d = docs(spark, *([same] * 30), same.replace("39", "x"), "nothing alike " * 9)
    sigs = dedup.minhash_signatures(d)
    assert {(r.a, r.b) for r in dedup.minhash_pairs(sigs, bucket_cap=None).collect()} == {(0, k) for k in range(1, 31)}
    assert dedup.minhash_pairs(sigs, bucket_cap=5).count() == 0


def test_near_joins_large_indexes(spark, monkeypatch):
    item = "what is the capital of the country that lies between the two seas"
    bench = spark.createDataFrame([("b_0", "toy", item, None), ("b_1", "toy", "another one, with other words", None)], "bench_id string, benchmark string, text string, code string")
    d = docs(spark, item, "unrelated text about cats", item + " and more", "", None)
    rows = lambda: sorted(map(tuple, contamination.near(d, bench, window=80, stride=40).collect()))
    held = rows()
    monkeypatch.setattr(contamination, "INDEX_BYTES", 0)
    assert rows() == held and any(r[2] for r in held)


def test_code_trees_are_those_of_brute_force(spark):
    codes = ["def f(x):\n    return x + 1", "def g(y):\n    return y + 2", "x = [i for i in range(3)]", "class A:\n    pass", "not python (", "", "import os\nprint(os)"]
    bench = spark.createDataFrame([(f"b_{i}", "toy", None, c) for i, c in enumerate(codes[1:5])], "bench_id string, benchmark string, text string, code string")
    d = docs(spark, *codes, None).union(docs(spark, codes[0], language="java").withColumn("doc_id", F.lit(99).cast("long")))
    got = {r.doc_id: r for r in contamination.code_ast(d, bench).collect()}

    def nodes(c):
        try:
            return [type(x).__name__ for x in ast.walk(ast.parse(c or ""))]
        except SyntaxError:
            return []

    for i, c in enumerate([*codes, None]):
        mine, best = nodes(c), (1, 0.0, "")
        for k, b in enumerate(codes[1:5]):
            other = nodes(b)
            if mine and other:
                j = len(set(mine) & set(other)) / len(set(mine) | set(other))
                best = min(best, (0 if mine == other else 1, -1.0 if mine == other else -j, f"b_{k}")) if best[2] else (0 if mine == other else 1, -1.0 if mine == other else -j, f"b_{k}")
        assert got[i].fingerprint_exact_match == (best[0] == 0 and best[2] != "") and got[i].ast_jaccard_max == pytest.approx(-best[1], abs=1e-4), i
    assert got[99].ast_fingerprint == ""
    p = {r.doc_id: r for r in domain.parsability(d).collect()}
    for i, c in enumerate([*codes, None]):
        n = len(nodes(c))
        bad = not (c or "").strip() or not n
        assert p[i].has_error == bad and (bad or p[i].total_node_count == n) and not p[i].unsupported_lang
    assert p[99].unsupported_lang and p[99].total_node_count == 0


def test_verbatim_in_parts(spark, monkeypatch):
    d = docs(spark, "one two three", "two", "nothing", None, "three two")
    items = spark.createDataFrame([(1, "two"), (2, "three"), (3, ""), (4, None), (5, "two")], "item_id long, text string")
    for most in (1 << 26, 16):
        monkeypatch.setattr(contamination, "INDEX_BYTES", most)
        assert sorted(map(tuple, contamination.verbatim(d, items).collect())) == [(0, 1), (0, 2), (0, 5), (1, 1), (1, 5), (4, 1), (4, 2), (4, 5)]
    assert contamination.verbatim(d, items.limit(0)).count() == 0


def test_cross_lingual_flag_and_losses(spark):
    l1 = spark.createDataFrame([(i, i == 0, False, "mmlu" if i == 0 else "") for i in range(4)], "doc_id long, is_exact_contaminated boolean, has_para_contamination boolean, matched_benchmarks string")
    l2 = spark.createDataFrame([(i, j, b, "mmlu") for i, j, b in ((0, 0.0, ""), (1, 0.5, "i1"), (2, 0.1, ""), (3, 0.9, "i9"))], "doc_id long, jaccard_max double, matched_bench_id string, matched_benchmark string")
    assert [r.doc_id for r in contamination.pending(l1, l2).collect()] == [1]
    l3 = spark.createDataFrame([(1, 0.8, "i2", "arc"), (2, 0.99, "i2", "arc")], "doc_id long, cos double, matched_bench_id string, matched_benchmark string")
    lang = spark.createDataFrame([(i, "zh") for i in range(4)], "doc_id long, language string")
    r = contamination.cascade(l1, l2, l3, languages=lang).orderBy("doc_id").collect()
    assert [x.verdict for x in r] == ["red", "yellow", "green", "red"] and [x.is_cross_lingual for x in r] == [True, True, False, True] and r[1].matched_bench_id == "i2"
    c = contamination.cascade_costs(contamination.cascade(l1, l2, l3)).first()
    assert (c.l3_processed, c.l1_red, c.l2_red, c.l2_green, c.yellow) == (1, 1, 1, 1, 1)
    bench = spark.createDataFrame([("i9", "toy", "x", None)], "bench_id string, benchmark string, text string, code string")
    lost = contamination.rejudge_losses(contamination.cascade(l1, l2, l3), docs(spark, "a", "b", "c", "d"), bench).first()
    assert (lost.yellow_docs, lost.without_text, lost.without_item) == (1, 0, 1)


# ---------------------------------------------------------------- personal data, languages, tokens


def test_further_entities_and_addresses_of_the_sixth_version(spark):
    d = docs(spark, "pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "PAN ABCDE1234F", "id 2345 6789 0123", "see https://a.b/c", "account number: 12345678", "Passport no. X12345678", "at 2a00:1450:4001:81b:0:0:0:200e", "fe80:0:0:0:0:0:0:1 2001:db8:0:0:0:0:0:1")
    r = sorted((x.doc_id, x.entity, x.placeholder) for x in safety.pii_hits(d).collect())
    assert r == [(0, "CRYPTO", False), (1, "IN_PAN", False), (2, "IN_AADHAAR", False), (3, "URL", False), (4, "US_BANK_NUMBER", False), (5, "US_PASSPORT", False), (6, "IP_ADDRESS", False), (7, "IP_ADDRESS", True), (7, "IP_ADDRESS", True)]


def test_code_language_prefers_metadata(spark):
    d = spark.createDataFrame([(0, '{"lang":"C++"}', "py"), (1, '{"language":"TS"}', "py"), (2, "{}", " Py "), (3, None, ""), (4, '{"lang":""}', "COBOL")], "doc_id long, meta string, language string")
    assert [r.c for r in d.orderBy("doc_id").select(domain.code_language(d).alias("c")).collect()] == ["cpp", "typescript", "python", "python", "cobol"]


def test_tokenizers_unknown_token(spark):
    pytest.importorskip("tokenizers")
    found = sorted(glob.glob("/opt/tokenizers/*.json"))
    if not found:
        pytest.skip("no tokenizer file")
    path = found[0]
    unk = tokenization.unknown_id(path)
    n = [r.n for r in docs(spark, "plain words", "").orderBy("doc_id").select(tokenization.hf_unknown(path)("text").alias("n")).collect()]
    assert n[1] == 0 and (unk is not None or n == [0, 0])


# ---------------------------------------------------------------- statistics


def test_intervals_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    x = {name: rng.normal(m, 1, 30) for name, m in (("a", 0.0), ("b", 0.8), ("zero", 0.0))}
    x["zero"][:] = 0
    d = spark.createDataFrame([(n, i, float(v)) for n, vs in x.items() for i, v in enumerate(vs)], "name string, example_id long, diff double")
    got = {r["name"]: r for r in decisions.paired_intervals(d, 600, 9).collect()}
    for n, v in x.items():
        g = np.random.default_rng(9)
        means = []
        while len(means) < 600:
            k = min(256, 600 - len(means))
            means += [np.mean([v[j] for j in row]) for row in g.integers(0, 30, (k, 30))]
        g, extreme, done = np.random.default_rng(9), 0, 0
        while done < 600:
            k = min(256, 600 - done)
            extreme += sum(abs(np.mean([s * y for s, y in zip(row * 2 - 1, v)])) >= abs(v.mean()) - 1e-15 for row in g.integers(0, 2, (k, 30)))
            done += k
        assert [got[n].low, got[n].high] == pytest.approx(np.quantile(means, [0.025, 0.975])) and got[n].p_value == pytest.approx(1.0 if v.mean() == 0 else (extreme + 1) / 601)


def test_target_resolution_and_matrix(spark):
    rng = np.random.default_rng(3)
    acc = {"a": 0.9, "b": 0.5, "c": 0.52}
    runs = spark.createDataFrame([(r, i, "g", float(rng.random() < p)) for r, p in acc.items() for i in range(300)], "recipe string, example_id long, grp string, accuracy double")
    res = decisions.target_resolution(runs, 400)
    got = {(r.left, r.right): r for r in res.collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"].decisive and got["a", "b"].direction == 1 and got["a", "b"].fdr_decisive and not got["b", "c"].decisive
    scores = runs.groupBy("recipe").agg(F.avg("accuracy").alias("target"))
    u = decisions.target_usable(res, scores, 0.25, least_pairs=2).first()
    assert u.pair_count == 3 and u.decisive_pairs == 2 and u.usable
    proxies = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 2.0), ("s", "c", 4.0), ("m", "a", 3.0), ("m", "b", 3.0), ("m", "c", 1.0)], "scale string, recipe string, proxy double")
    m = {r["scale"]: (r.correct, r.ties, r.accuracy) for r in decisions.decision_matrix(res, proxies).collect()}
    assert m == {"s": (1, 0, 0.5), "m": (1, 1, 0.5)}


def test_paired_runs_must_agree(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 0.0)], "example_id long, grp string, accuracy double")
    assert sorted(r["diff"] for r in decisions.paired_units(a, a.withColumn("accuracy", F.lit(0.5))).collect()) == [-0.5, 0.5]
    for other in (a.where("example_id = 1"), a.withColumn("grp", F.lit("y"))):
        with pytest.raises(Exception, match="same examples|another group"):
            decisions.paired_units(a, other).collect()


def test_mergers_name_what_stages_report(spark):
    rows = [("s1", "total_docs", None, 4.0), ("s2", "total_docs", None, 6.0), ("s1", "contaminated_docs", None, 1.0), ("s1", "ngram_size", None, 13.0), ("s2", "ngram_size", None, 13.0), ("s1", "contaminated_pct", None, 0.25), ("s2", "total_paras", None, 0.0)]
    m = {(r.metric, r.key): r.value for r in merge.merged_stage(spark.createDataFrame(rows, "shard string, metric string, key string, value double"), "ngram_dedup").collect()}
    assert m == {("total_docs", None): 10, ("contaminated_docs", None): 1, ("total_paras", None): 0, ("contaminated_pct", None): 0.1, ("contaminated_para_pct", None): 0, ("ngram_size", None): 13, ("aggregated_from", None): 2}
    assert len(merge.MERGERS) == 11
    verdicts = spark.createDataFrame([("d", "m", 1.0, 2.0, "FAIL")], "dim string, metric string, positive double, negative double, verdict string")
    assert "| d | m | 1.0 | 2.0 | FAIL |" in merge.markdown(verdicts)


# ---------------------------------------------------------------- files


def test_token_blocks_permuted_and_cyclic(spark, tmp_path):
    np.arange(10, dtype="<u2").tofile(tmp_path / "a.bin")
    b = reader.token_blocks(spark, str(tmp_path / "a.bin"), 3, seed=5)
    order = np.random.default_rng(5).permutation(3)
    want = [list(range(3 * k, 3 * k + 3)) for k in order]
    assert [r.tokens for r in b.orderBy("position").collect()] == want
    assert [r.tokens for r in reader.cyclic(b, 2, 5).orderBy("index").collect()] == [want[k % 3] for k in range(2, 7)]
    with pytest.raises(ValueError):
        reader.token_blocks(spark, str(tmp_path / "a.bin"), 1)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="aligned"):
        reader.token_blocks(spark, str(tmp_path / "odd.bin"), 2).collect()


def test_benchmark_files_of_all_forms(spark, tmp_path):
    for name, content in (("l.jsonl", '{"q":"a"}\n\n{"q":["b"]}\n'), ("list.json", '[{"q":"a"},{"q":"b"}]'), ("map.json", '{"x":{"q":"a"},"y":{"q":"b"}}'), ("one.json", '{"q":"a","c":"x=1"}')):
        (tmp_path / name).write_text(content)
    read = lambda n, **k: sorted((r.bench_id, r.text, r.code) for r in reader.benchmark(spark, str(tmp_path / n), "t", "q", **k).collect())
    assert read("l.jsonl") == [("t_0", "a", None), ("t_2", '["b"]', None)] and read("list.json") == read("map.json") == [("t_0", "a", None), ("t_1", "b", None)] and read("one.json", code_field="c") == [("t_0", "a", "x=1")]
    spark.createDataFrame([("a",), ("b",)], "q string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [x[0] for x in read("p")] == ["t_0", "t_1"]
    for bad in (lambda: reader.registry(), lambda: reader.registry(specs={"x": {}}, spark=spark), lambda: reader.benchmark(spark, "x", "t", "")):
        with pytest.raises(ValueError):
            bad()


def test_matrix_of_another_protocol(spark, tmp_path):
    (tmp_path / "s" / "r" / "b").mkdir(parents=True)
    (tmp_path / "s" / "r" / "b" / "summary.json").write_text('{"protocol":"old"}')
    assert reader.matrix_runs(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="unexpected protocol"):
        reader.matrix_runs(spark, str(tmp_path), "new").collect()


def test_summaries_and_output_folders(spark, tmp_path):
    at = sinks.output_dir(str(tmp_path), "web", "stats")
    assert at.startswith(f"{tmp_path}/web_") and at.endswith("/stats")
    sinks.write_summary(spark.createDataFrame([(3, 0.5)], "total_docs long, share double"), at)
    assert json.load(open(f"{at}/summary.json"))["total_docs"] == 3
    with pytest.raises(ValueError):
        sinks.write_summary(spark.createDataFrame([(float("nan"),)], "x double"), at)
    sinks.put(spark, f"{tmp_path}/summary.json", '{"total_docs": 100}')  # the base's own is no shard
    assert [(r.metric, r.value) for r in reader.summaries(spark, str(tmp_path)).orderBy("metric").collect()] == [("share", 0.5), ("total_docs", 3.0)]


def test_predictions_are_ascii(spark, tmp_path):
    sinks.write_predictions(spark.createDataFrame([(1, "é")], "b long, a string"), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ['{"a":"\\u00e9","b":1}']


def test_index_of_other_parameters(spark, tmp_path):
    sinks.write_bench_index(str(tmp_path), hashes=spark.range(1), n=5)
    assert sinks.read_bench_index(spark, str(tmp_path), ("hash",), n=5)["hash"].count() == 1
    with pytest.raises(ValueError):
        sinks.read_bench_index(spark, str(tmp_path), ("hash",), n=6)


def test_run_recorder(tmp_path):
    r = sinks.RunRecorder(str(tmp_path / "run"), "trial", "cmd", {"a": 1})
    again = sinks.RunRecorder(str(tmp_path / "run"), "other")
    assert again.run_id == r.run_id and json.load(open(tmp_path / "run" / "run_manifest.json"))["run_name"] == "trial"
    r.event("start", step=1)
    again.event("end")
    assert [json.loads(x)["event"] for x in open(tmp_path / "run" / "events.jsonl")] == ["start", "end"]
    assert r.status("done", docs=3)["state"] == "done" and json.load(open(tmp_path / "run" / "status.json"))["docs"] == 3
    (tmp_path / "ck").mkdir()
    (tmp_path / "ck" / "w").write_bytes(b"abc")
    assert r.checkpoint(str(tmp_path / "ck"), 7)["files"] == [{"path": "w", "size": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}]
    with pytest.raises(FileNotFoundError):
        r.checkpoint(str(tmp_path / "none"), 1)


def test_choices_are_shuffled_by_example():
    order = list(range(4))
    random.Random(int.from_bytes(hashlib.sha256(b"111:q1").digest()[:8], "big")).shuffle(order)
    assert reader.shuffled_choices([" a", "b", "c ", "d"], 2, "q1") == ([["a", "b", "c", "d"][k] for k in order], order.index(2))
    assert len({tuple(reader.shuffled_choices(list("abcd"), 0, str(k))[0]) for k in range(50)}) > 10


def test_dense_indexes(spark):
    d = spark.createDataFrame([(i, r) for i, r in enumerate([7, 3, 3, 90, 7, 11])], "doc_id long, root long")
    assert {r.doc_id: r.cluster_index for r in dedup.dense_clusters(d, "root", "doc_id").collect()} == {0: 1, 1: 0, 2: 0, 3: 3, 4: 1, 5: 2}


def test_shards_are_written_once(spark, tmp_path):
    d = spark.range(3)
    assert sinks.write_shard(d, str(tmp_path), "a") and not sinks.write_shard(d, str(tmp_path), "a") and sinks.write_shard(d, str(tmp_path), "b")
    assert [r.id for r in sinks.remaining(spark.range(5), d, "id").orderBy("id").collect()] == [3, 4]



# ---------------------------------------------------------------- findings of the third round


def test_embedding_search_in_parts(spark, monkeypatch):
    rng = np.random.RandomState(3)
    v, w = rng.randn(30, 8).round(1), rng.randn(40, 8).round(1)
    w[7] = w[31] = w[2] * 2  # ties go by name
    d = spark.createDataFrame([(f"d{i}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "doc_id string, embedding array<double>")
    b = spark.createDataFrame([(f"i{i}", "b", x.tolist()) for i, x in enumerate(w)], "bench_id string, benchmark string, embedding array<double>").repartition(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit(v) @ unit(w).T, 6)
    joins = []
    monkeypatch.setattr(type(d), "crossJoin", lambda *a: joins.append(a))  # no pair is a row
    for most in (contamination.INDEX_BYTES, 8 * 8 * 12):
        monkeypatch.setattr(contamination, "INDEX_BYTES", most)
        r = {x.doc_id: x for x in contamination.embed(d, b).collect()}
        for i in range(30):
            top = sorted(range(40), key=lambda j: (-cos[i, j], f"i{j}"))[:5]
            assert r[f"d{i}"].top_ids == ",".join(f"i{j}" for j in top) and r[f"d{i}"].cos_max == pytest.approx(cos[i, top[0]], abs=1e-4)
        assert r["none"].cos_max is None and r["none"].top_ids == "i0,i1,i10,i11,i12"
    assert not joins


def test_matches_are_those_of_whole_signatures(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [prose(30) for _ in range(20)] + ["abc", "ab", "ünïcödé 文本文本文本 " * 3]
    texts = [prose(rng.randint(1, 400)) for _ in range(60)] + [prose(20) + " " + t + " " + prose(20) for t in items] + [*items, None, "", " abc\n", "\U0001f600" * 40 + "ünïcödé 文本文本文本 " * 3, "a" * 700]
    a, b = dedup.permutations(32, 1)
    item = pa.array(items)
    sigs = np.concatenate([s for _, _, s in arrays.signatures(item, 5, a, b, dedup.PRIME)])
    for window, stride, n_bands, size in ((None, None, 8, 1 << 20), (100, 50, 8, 1 << 20), (100, 50, 16, 3000)):
        monkeypatch.setattr(arrays.parts, "__defaults__", (size,))
        rows, want = 32 // n_bands, set()
        for row, _, sig in arrays.signatures(pa.array(texts), 5, a, b, dedup.PRIME, window, stride):
            equal = sig[:, None, :] == sigs[None]
            for w, i in zip(*np.nonzero(equal.reshape(len(sig), len(sigs), n_bands, rows).all(3).any(2))):
                want.add((int(row[w]), int(i), round(float(equal[w, i].mean()), 6), w))
        found = [(int(r), int(i), round(float(j), 6)) for row, item_, share in arrays.matches(pa.array(texts), arrays.Sought(sigs, n_bands, a, b, dedup.PRIME), 5, a, b, window, stride) for r, i, j in zip(row, item_, share)]
        assert sorted(found) == sorted(x[:3] for x in want) and len(found) > 20


def test_minima_of_few_windows_are_computed(monkeypatch):
    import pyarrow as pa

    a, b = dedup.permutations(128, 1)
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [prose(30) for _ in range(10)]
    texts = [prose(300) for _ in range(40)] + [items[3] + " " + prose(100)]
    seen = []
    some = arrays.Minima.some
    monkeypatch.setattr(arrays.Minima, "some", lambda self, x, y, w: seen.extend(w.tolist()) or some(self, x, y, w))
    sigs = np.concatenate([s for _, _, s in arrays.signatures(pa.array(items), 5, a, b, dedup.PRIME)])
    found = list(arrays.matches(pa.array(texts), arrays.Sought(sigs, 32, a, b, dedup.PRIME), 5, a, b, 300, 150))
    assert {(int(r), int(i)) for row, item, _ in found for r, i in zip(row, item)} == {(40, 3)} and len(set(seen)) < 10


def test_distinct_shingles_of_a_stream(spark, tmp_path):
    texts = ["a b c d e", "b c\td\n e  f", "x", " x ", "", None, "ü b c", "c d e"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    fold, result = folds.shingle_runs(3)
    spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {" ".join(w[i : i + 3]) for w in ((t or "").split() for t in texts) for i in range(max(1, len(w) - 2)) if w}
    assert result(spark).count() == len(want) == 6
    fold(d, 0)  # a repeated batch replaces its run
    assert result(spark).count() == 6


def test_a_stream_has_files_of_the_tables_size(spark, tmp_path, monkeypatch):
    from sedimenta.plans import extended

    none = F.lit(None).cast("string")
    d = spark.range(0, 400, 1, 10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), none.alias("url"), none.alias("timestamp"), none.alias("language"))
    monkeypatch.setattr(extended, "documents", lambda *a: d)
    batches = []
    extended._folded(spark, extended._stream(spark, "", "many"), lambda b, i: batches.append((b.select(F.input_file_name()).distinct().count(), b.count())))
    assert len(batches) == 3 and sum(n for _, n in batches) == 400 and sorted(f for f, _ in batches) == [2, 4, 4]


def test_shingle_digests_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 7)
    han = "中文文本没有空格所以按字符切分成片段" * 3
    texts = [han, han[:4], "中 文\n本" * 9, "a b c", "a", "", None, "  x\ty\x0bz  ", "ab" + han[:2], "ab中文中" * 5 + "\U0001f600"]
    d = docs(spark, *texts)
    e = d.select("doc_id", T.is_cjk(F.col("text")).alias("c"), T.any_shingles(F.col("text"), 2).alias("g")).select("doc_id", "c", F.size("g"), F.md5(F.array_join("g", "|")))
    assert sorted(map(tuple, dedup.shingle_digests(d, 2).collect())) == sorted(map(tuple, e.collect()))


def test_languages_in_one_walk(spark):
    texts = ["THE cat, and the... dog; LE le! la?", "123\n456", "\n \t", "", None, "für FÜR auf", "привет мир the\nи", "中文中文中文中文 the", "a日本のひらがな\n\n", "ΑΒΓ abc", "the\x0band\x0cof\x85to"]
    d = docs(spark, *texts, language="EN")
    g = {r.doc_id: r for r in cleaning.glotlid(d).collect()}
    assert [g[i].lang_script for i in range(11)] == ["eng_Latn", "und", "und", "und", "und", "deu_Latn", "rus_Cyrl", "zho_Hani", "jpn_Hira", "ell_Grek", "eng_Latn"]
    r = {x.doc_id: x for x in cleaning.langid(d).collect()}
    assert (r[0].lang, r[0].confidence, r[0].lang_mismatch) == ("en", round(3 / 7, 4), False) and r[0].top3 == "en,fr,es" and (r[5].lang, r[5].confidence, r[5].lang_mismatch) == ("de", 1.0, True)
    assert r[1].lang == r[4].lang == "unknown" and r[10].confidence == 1.0
    assert "Filter" not in cleaning.glotlid(d)._jdf.queryExecution().executedPlan().toString() and "Join" not in cleaning.glotlid(d)._jdf.queryExecution().executedPlan().toString()


def test_signatures_of_shingles_are_those_of_plain_python(spark, monkeypatch):
    monkeypatch.setattr(dedup, "AT_ONCE", 50)
    han = "中文文本没有空格所以按字符切分成片段再来一些字符"
    texts = ["a  b\tc d e f g h i", "a b c d e f g h", "x " * 40, han * 2 + "\n \t" + han, "ü ö ä ß é à ô î ñ ç", "\x0bone two\x0cthree four five six seven eight nine\x85ten eleven", "", None, *(" ".join(str(i * j % 17) for j in range(60)) for i in range(9))]
    d = docs(spark, *texts)
    a, b = dedup.permutations(16, 1)
    grams = {r.doc_id: r.s for r in d.select("doc_id", T.any_shingles(F.coalesce("text", F.lit("")), 5).alias("s")).collect()}
    h = {i: [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in s] for i, s in grams.items() if len(s) >= 5}
    want = {i: [min((x * int(p) + int(q)) % dedup.PRIME for x in v) for p, q in zip(a, b)] for i, v in h.items()}
    sigs = dedup.minhash_signatures(d, k=16)
    assert {r.doc_id: r.sig for r in sigs.collect()} == want and len(want) == 14
    assert "transform(" not in sigs._jdf.queryExecution().executedPlan().toString()  # no interpreted lambda a word
    assert [r.sig for r in dedup.minhash_signatures(docs(spark, "a b"), k=16, legacy_sentinel=True).collect()] == [[dedup.PRIME] * 16]


def test_ngrams_of_earlier_paragraphs_are_those_of_brute_force(spark):
    rng = random.Random(9)
    line = lambda: " ".join(str(rng.randint(100, 999)) for _ in range(rng.randint(13, 40)))
    known = [line() for _ in range(12)]
    texts = {f"d{i:03}": "\n\n".join([*(rng.choice(known) + (" x" * 5 if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 4))), line(), "short  one " * 5 + "end", "tiny"]) for i in range(60)}
    texts |= {"e1": "", "e2": None, "e3": known[0] + "\n\n" + known[0]}
    d = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string").repartition(5)
    first, want, grams = {}, {}, {}
    for k in sorted(texts):
        for i, p in enumerate(x for x in ((texts[k] or "").split("\n\n")) if len(x.strip()) >= 50):
            w = p.split()
            grams[k, i] = {" ".join(w[j : j + 13]) for j in range(len(w) - 12)} if len(w) >= 13 else {p.strip()}
            for g in grams[k, i]:
                first.setdefault(g, (k, i))
    for k in texts:
        o = [sum(first[g] < (k, i) for g in grams[k, i]) / len(grams[k, i]) for i in range(99) if (k, i) in grams]
        want[k] = (len(o), round(sum(x >= 0.5 for x in o) / max(len(o), 1), 4), round(sum(o) / max(len(o), 1), 4))
    n = dedup.ngram(d)
    got = {r.doc_id: (r.para_count, r.para_contamination_ratio, r.mean_shingle_overlap) for r in n.collect()}
    assert got.keys() == want.keys() and all(g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=1.1e-4) for g, w in ((got[k], want[k]) for k in want))
    assert "Window" not in n._jdf.queryExecution().executedPlan().toString() and sum(g[1] > 0 for g in got.values()) > 30


def test_tasks_of_an_exchange_follow_the_splits(spark):
    from sedimenta.functions.session import gathered

    d = spark.range(0, 100, 1, 10).select((F.col("id") % 50).alias("shard"))
    assert [gathered(d, "shard", 512, n).rdd.getNumPartitions() for n in (0, 10, 1000)] == [4, 40, 512]
    assert gathered(d, "shard", 512, 10).groupBy("shard").applyInArrow(lambda t: t[:1], "shard long").count() == 50

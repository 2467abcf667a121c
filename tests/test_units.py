import json

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.functions.graph import components, roots
from sedimenta.operators import cleaning, contamination, decisions, dedup, domain, merge, safety, source_audit, tokenization
from sedimenta.sources import reader, sinks
from sedimenta.streaming import folds


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


def docs(spark, *texts, **more):
    rows = [(i, t, more.get("source"), more.get("language", "en")) for i, t in enumerate(texts)]
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, "doc_id long, text string, source string, language string").withColumn("url", none).withColumn("timestamp", none)


def test_text_functions(spark):
    assert one(spark, " a  b\tc\n", T.words) == ["a", "b", "c"] and one(spark, None, T.words) == []
    assert one(spark, "a b c", lambda c: T.shingles(T.words(c), 2)) == ["a b", "b c"] and one(spark, "a", lambda c: T.shingles(T.words(c), 2)) == ["a"]
    assert one(spark, " abcd ", lambda c: T.char_ngrams(c, 3)) == ["abc", "bcd"]
    assert one(spark, "abcdefgh", lambda c: T.windows(c, 4, 3)) == ["abcd", "defg", "gh"] and one(spark, "abc", lambda c: T.windows(c, 4, 3)) == ["abc"]
    assert [one(spark, n, T.length_bucket, "long") for n in (0, 4000, 8000, 32000, 128000, 256000)] == ["<4k", "4k-8k", "8k-32k", "32k-128k", "128k-256k", ">=256k"]
    assert [one(spark, u, T.url_domain) for u in (None, "", "http://u@h:1/x", "mailto:x")] == ["(no_url)", "(no_url)", "u@h:1", "(empty_netloc)"]
    assert one(spark, "2024-02-03 04:05:06", lambda c: F.date_format(T.parsed_timestamp(c), "yyyy-MM")) == "2024-02" and one(spark, "nope", T.parsed_timestamp) is None
    assert one(spark, "aabb", T.entropy) == 1.0
    assert one(spark, "中文字ab", T.cjk_share) == pytest.approx(0.6)


def test_exact_marks_all_members(spark):
    r = {x.doc_id: x for x in dedup.exact(docs(spark, "same", "same", "other")).collect()}
    assert [r[i].is_exact_dup for i in range(3)] == [True, True, False]


def test_repetition_flags_only_the_loop(spark):
    varied, looped = " ".join(f"w{i}" for i in range(200)), " ".join(["a b c d e f g h"] * 40)
    r = dedup.repetition(docs(spark, varied, looped, "", None)).orderBy("doc_id").collect()
    assert [x.is_high_repetition for x in r] == [False, True, False, False]


def test_extraction(spark):
    d = docs(spark, "See https://a.org/x for details on the matter, which goes on for a while.", "<p>one</p><p>two</p><p>three words and more of them here, long enough</p>", "404", "")
    r = cleaning.extraction(d).orderBy("doc_id").collect()
    assert (r[0].url_count, r[0].low_extraction_quality) == (1, False)
    assert r[1].has_html_residue and r[1].low_extraction_quality and r[2].too_short_stub and not r[3].too_short_stub


def test_gopher_and_c4(spark):
    good = " ".join(["the cat sat with a dog and that was to be seen of course."] * 6)
    r = cleaning.quality(docs(spark, good, "", "too short.", "x { y z w.\n" * 3, "Lorem ipsum dolor sit.\n{ a b c.")).orderBy("doc_id").collect()
    assert r[0].gopher_quality and r[1].gopher_quality_reason == "empty" and r[2].gopher_quality_reason == "too_few_words"
    assert r[3].c4_quality_reason == "curly_bracket" and r[4].c4_quality_reason == "lorem_ipsum" and r[1].c4_quality_reason == "too_few_sentences"
    with pytest.raises(ValueError):
        cleaning.quality(docs(spark, "x"), ("nope",))


def test_languages(spark):
    r = cleaning.glotlid(docs(spark, "the cat and the dog", "中文文本", "", "привет мир")).orderBy("doc_id").collect()
    assert [x.lang_script for x in r] == ["eng_Latn", "zho_Hani", "und", "rus_Cyrl"]


def test_placeholders_and_luhn(spark):
    d = docs(spark, "write ann.lee@real.org or test@example.com, 10.0.0.1 and 8.8.8.8, 4111111111111111 not 4111111111111112")
    r = {(x.entity, x.placeholder) for x in safety.pii_hits(d).collect()}
    assert r == {("EMAIL_ADDRESS", False), ("EMAIL_ADDRESS", True), ("IP_ADDRESS", True), ("IP_ADDRESS", False), ("CREDIT_CARD", False)}


def test_secrets_and_licenses(spark):
    d = docs(spark, 'x\ntoken = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "All rights reserved. Copyright 2020 Some One\n", 'token = "aaaaaaaaaaaaaaaaaaaa"')
    assert [(x.doc_id, x.rule, x.line_no) for x in safety.secret_hits(d).collect()] == [(0, "generic-token", 2)]
    r = source_audit.license_audit(d).orderBy("doc_id").collect()
    assert r[1].has_license and r[1].copyright_holders == "Some One" and not r[0].has_license


def test_toxicity_routing(spark):
    r = safety.toxicity(docs(spark, "a calm text", "idiot moron loser", "")).orderBy("doc_id").collect()
    assert [x.high_risk for x in r] == [False, True, False] and r[2].n_chunks == 1


def test_near_and_code_contamination(spark):
    item = "what is the capital of the country that lies between the two seas and has ten rivers"
    bench = spark.createDataFrame([("b_0", "toy", item, None), ("b_1", "toy", None, "def f(x):\n    return x + 1")], "bench_id string, benchmark string, text string, code string")
    d = docs(spark, item, "something else entirely, about cats", "def f(x):\n    return x + 1", "def g(y):\n    return y + 2", "")
    r = contamination.near(d, bench).orderBy("doc_id").collect()
    assert [x.is_near_contaminated for x in r] == [True, False, True, False, False] and r[0].matched_bench_id == "b_0" and r[2].matched_kind == "code"
    assert [x.is_code_near_dup for x in contamination.code_near(d, bench).orderBy("doc_id").collect()] == [False, False, True, False, False]
    a = contamination.code_ast(d, bench).orderBy("doc_id").collect()
    assert a[2].fingerprint_exact_match and a[3].is_ast_contaminated and not a[0].is_ast_contaminated
    e = contamination.exact(d, bench).orderBy("doc_id").collect()
    assert e[0].is_exact_contaminated and e[2].matched_benchmarks == "toy" and not e[1].is_exact_contaminated


def test_minhash_and_graph(spark):
    a = " ".join(f"w{i}" for i in range(12))
    r = dedup.minhash(docs(spark, a, a, "different words " + " ".join(f"v{i}" for i in range(12)), ""), n=2, n_bands=4, rows=4).orderBy("doc_id").collect()
    assert [x.is_near_dup for x in r] == [True, True, False, False] and r[1].cluster_id == 0
    e = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 9] + [(50, 40)], "u long, v long")
    root = {x.node: x.root for x in components(e).collect()}
    assert root == {**{i: 0 for i in range(1, 10)}, **{i: 10 for i in range(11, 31)}, 50: 40}
    p = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "node long, parent long")
    assert {x.root for x in roots(p).collect()} == {0}


def test_tokenization_spans(spark):
    r = tokenization.tokenize(docs(spark, "a ```x = 1``` b $y$ and $$z+z$$ \\begin{q}w\\end{q}", "", None)).orderBy("doc_id").collect()
    assert r[0].code_char_count == 11 and r[0].latex_char_count == 3 + 7 + 17 and r[1].fertility == 0.0 and not r[2].high_fertility


def test_tokenizer_file(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    r = tokenization.tokenize(docs(spark, "hello world", ""), tokenization.hf_tokens(tokenizers.path("byte_bpe_50k.json"))).orderBy("doc_id").collect()
    assert [x.token_count for x in r] == [2, 0]


def test_domain(spark):
    r = domain.parsability(docs(spark, "x = 1", "def (", "", language="py")).orderBy("doc_id").collect()
    assert [x.has_error for x in r] == [False, True, True]
    assert domain.parsability(docs(spark, "x", language="cobol")).first().unsupported_lang
    s = domain.stem(spark.createDataFrame([(1, "skip"), (2, "512.3,x")], "doc_id long, reply string")).orderBy("doc_id").collect()
    assert s[0].parse_failed and s[1].fdc_top_class == 500 and s[1].is_stem
    b = domain.binoculars(spark.createDataFrame([(1, 0.7, 1.0), (2, 1.1, 1.0), (3, 1.0, 0.0)], "doc_id long, nll double, cross_entropy double"), 0.85)
    assert [x.is_ai_generated for x in b.orderBy("doc_id").collect()] == [True, False, False]
    c = {(x.name, x.parameter): x.valid for x in domain.config_audit(spark, [("y", "a:\n  reset_position_ids: true\n"), ("f", "--eod-mask-loss --x 1")]).collect()}
    assert c["y", "reset_position_ids"] and c["f", "eod_mask_loss"] and not c["y", "eod_mask_loss"]


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    assert [x.q_value for x in decisions.benjamini_hochberg(p).orderBy("name").collect()] == [0.03, 0.04, 0.04]
    up = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0)], "recipe string, proxy double, target double")
    assert decisions.kendall_tau_b(up).first().tau_b == 1.0
    assert decisions.kendall_tau_b(up.withColumn("target", -F.col("target"))).first().tau_b == -1.0
    assert decisions.kendall_tau_b(up.limit(1)).first().tau_b is None
    v = spark.createDataFrame([(0.5, 0.4, True), (0.4, 0.5, True), (0.5, 0.5, True), (None, 1.0, True), (1.0, 0.5, None)], "p double, n double, h boolean")
    assert [x.v for x in v.select(decisions.direction(F.col("p"), F.col("n"), F.col("h")).alias("v")).collect()] == ["PASS", "FAIL", "TIE", "ERR", "~"]


def test_merge(spark):
    s = spark.createDataFrame([("a", "total_docs", 2.0), ("b", "total_docs", 3.0), ("a", "threshold", 0.5)], "shard string, metric string, value double")
    assert [(x.metric, x.value) for x in merge.merged(s).collect()] == [("total_docs", 5.0)]


def test_reader(spark, tmp_path):
    (tmp_path / "corpus_zh").mkdir()
    (tmp_path / "corpus_zh" / "a.jsonl").write_text(json.dumps({"uid": 12, "content": "hi", "style": "qa", "language": "en"}) + "\n\n")
    d = reader.corpus(spark, str(tmp_path / "corpus_zh" / "a.jsonl"), rename={"uid": "doc_id", "content": "text"}, path_meta={"source": {"corpus_zh": "web"}, "language": {"corpus_zh": "zh"}})
    r = d.first()
    assert (r.doc_id, r.text, json.loads(r.meta), r.source, r.language) == ("12", "hi", {"style": "qa"}, "web", "en")
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "1", "text": null}\n{"doc_id": "2", "text": "x"}\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        reader.corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    assert reader.corpus(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    (tmp_path / "t.u16").write_bytes(bytes([1, 0, 2, 0, 3, 1, 9, 9]))
    assert [x.tokens for x in reader.token_blocks(spark, str(tmp_path / "t.u16"), 2).orderBy("block").collect()] == [[1, 2], [259, 2313]]


def test_sinks(spark, tmp_path):
    e = dedup.exact(docs(spark, "a", "a"))
    sinks.write_per_doc(e, str(tmp_path / "out"), ("is_exact_dup", "has_para_dups"))
    row = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert set(row) == {"schema_version", "artifact_type", "doc_id", "scores", "flags"} and row["flags"]["is_exact_dup"] is True
    with pytest.raises(ValueError):
        sinks.contract(e, ("dup_doc_count",))
    sinks.write_index(e.select("doc_hash"), str(tmp_path / "index"), sep="\n\n")
    assert sinks.read_index(spark, str(tmp_path / "index"), sep="\n\n").count() == 2
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path / "index"), sep="x")


def test_streaming(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = folds.event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), late="10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == e.count()

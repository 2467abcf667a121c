"""The registered queries: each a plan over whole tables of one folder, with its DuckDB counterpart.

``tables`` adapts the folder's tables to the document model.  An oracle is SQL for the
same rows; where SQL can't express an operator there is none, and the tests compare
it with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import summary as S
from ..functions import text as T
from ..operators import cleaning, contamination, decisions, dedup, domain, merge, safety, source_audit, tokenization
from ..sources import reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEP = "\n"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the seven fields, ids as they are (the order of order-dependent operators)."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", none.alias("url"), none.alias("timestamp"), F.col("lang").alias("language"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("bench_id"), F.lit("bench").alias("benchmark"), "text", F.lit(None).cast("string").alias("code"))


WS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
PARAS = r"list_filter(list_transform(string_split({0}, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 50)"
BUCKET = "CASE WHEN {0} >= 256000 THEN '>=256k' WHEN {0} >= 128000 THEN '128k-256k' WHEN {0} >= 32000 THEN '32k-128k' WHEN {0} >= 8000 THEN '8k-32k' WHEN {0} >= 4000 THEN '4k-8k' ELSE '<4k' END"
_WS_TEXT = WS.format("text")


# ---------------------------------------------------------------- exact and paragraph duplicates

EXACT = f"""
    d AS (SELECT doc_id, md5(text) AS doc_hash, {PARAS.format('text')} AS ps FROM documents),
    p AS (SELECT doc_id, md5(unnest(ps)) AS h FROM d), m AS (SELECT h, count(*) AS n FROM p GROUP BY 1),
    u AS (SELECT doc_id, sum((n > 1)::int) AS dups FROM p JOIN m USING (h) GROUP BY 1),
    x AS (SELECT doc_id, doc_hash, count(*) OVER (PARTITION BY doc_hash) AS dup_doc_count, coalesce(dups, 0)::bigint AS para_dup_count,
          CASE WHEN len(ps) > 0 THEN round(coalesce(dups, 0) / len(ps), 4) ELSE 0.0 END AS para_dup_ratio FROM d LEFT JOIN u USING (doc_id))"""


@query(f"WITH {EXACT} SELECT *, dup_doc_count > 1 AS is_exact_dup, para_dup_count > 0 AS has_para_dups FROM x")
def exact_dedup(spark, sf_dir):
    return dedup.exact(documents(spark, sf_dir), SEP)


@query(f"""WITH {EXACT} SELECT count(*) AS total_docs, sum((dup_doc_count > 1)::int)::bigint AS exact_dup_docs, round(avg((dup_doc_count > 1)::int), 4) AS exact_dup_pct,
       count(DISTINCT doc_hash) AS unique_doc_hashes, sum((para_dup_count > 0)::int)::bigint AS para_dup_docs FROM x""")
def exact_dedup_summary(spark, sf_dir):
    e = dedup.exact(documents(spark, sf_dir), SEP)
    return e.agg(F.count("*").alias("total_docs"), S.flagged("is_exact_dup").alias("exact_dup_docs"), S.share(S.flagged("is_exact_dup"), F.count("*")).alias("exact_dup_pct"), F.countDistinct("doc_hash").alias("unique_doc_hashes"), S.flagged("has_para_dups").alias("para_dup_docs"))


@query(f"SELECT h AS para_hash, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, md5(unnest({PARAS.format('text')})) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1")
def paragraph_dedup(spark, sf_dir):
    p = documents(spark, sf_dir).select("doc_id", F.explode(T.paragraphs(F.col("text"), SEP, 50)).alias("p"))
    return p.groupBy(F.md5("p").alias("para_hash")).agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("docs")).where("occurrences > 1")


# ---------------------------------------------------------------- sizes and sources

STATS = f"s AS (SELECT doc_id, length(text)::bigint AS char_count, len({_WS_TEXT})::bigint AS token_count, source, lang AS language FROM documents)"


@query(f"WITH {STATS} SELECT doc_id, char_count, token_count, {BUCKET.format('token_count')} AS length_bucket, true AS missing_timestamp, true AS missing_url, coalesce(language = '', true) AS missing_language, coalesce(source = '', true) AS missing_source FROM s")
def doc_stats(spark, sf_dir):
    return source_audit.doc_stats(documents(spark, sf_dir)).drop("source", "url", "language", "timestamp")


@query(f"""WITH {STATS} SELECT count(*) AS n, round(avg(token_count), 4) AS mean, round(stddev_pop(token_count), 4) AS std, min(token_count) AS min, max(token_count) AS max,
       round(quantile_cont(token_count, 0.05), 4) AS p5, round(quantile_cont(token_count, 0.5), 4) AS p50, round(quantile_cont(token_count, 0.95), 4) AS p95, round(quantile_cont(token_count, 0.99), 4) AS p99 FROM s""")
def doc_stats_summary(spark, sf_dir):
    return S.spread(source_audit.doc_stats(documents(spark, sf_dir)), "token_count")


@query(f"WITH {STATS} SELECT {BUCKET.format('token_count')} AS length_bucket, count(*) AS docs FROM s GROUP BY 1")
def length_buckets(spark, sf_dir):
    return S.distribution(source_audit.doc_stats(documents(spark, sf_dir)), F.col("length_bucket"), "length_bucket")


_GROUP = "WITH " + STATS + " SELECT {0}, count(*) AS docs, sum(token_count)::bigint AS tokens, round(sum(token_count) / sum(sum(token_count)) OVER (), 4) AS pct_tokens FROM s GROUP BY 1"


@query(_GROUP.format("language"))
def language_distribution(spark, sf_dir):
    return S.group_table(source_audit.doc_stats(documents(spark, sf_dir)), F.col("language"), "language")


@query(_GROUP.format("source"))
def source_distribution(spark, sf_dir):
    return S.group_table(source_audit.doc_stats(documents(spark, sf_dir)), F.col("source"), "source")


@query("""SELECT CASE WHEN url IS NULL OR url = '' THEN '(no_url)' WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) = '' THEN '(empty_netloc)'
       ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) END AS domain, count(*) AS docs FROM pages GROUP BY 1""")
def url_domain_distribution(spark, sf_dir):
    return S.distribution(table(spark, sf_dir, "pages"), T.url_domain(F.col("url")), "domain")


@query("SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS events FROM events GROUP BY 1")
def timestamp_coverage(spark, sf_dir):
    ts = F.date_format(T.parsed_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "yyyy-MM")
    return table(spark, sf_dir, "events").groupBy(ts.alias("year_month")).agg(F.count("*").alias("events"))


@query("SELECT doc_id, source FROM documents ORDER BY substr(sha256('42:' || doc_id::varchar), 1, 16), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return reader.hash_sample(documents(spark, sf_dir).select("doc_id", "source"), 100, 42)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def head_sample(spark, sf_dir):
    return reader.head_sample(documents(spark, sf_dir).select("doc_id", "source"), 100)


_LIC = "l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line_no FROM documents)"
_RULES = ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in source_audit.LICENSES)


@query(f"WITH {_LIC}, r(spdx, pattern) AS (VALUES {_RULES}) SELECT doc_id, spdx, line_no::bigint AS line_no FROM l JOIN r ON regexp_matches(line, pattern)")
def license_hits(spark, sf_dir):
    return source_audit.license_hits(documents(spark, sf_dir))


# ---------------------------------------------------------------- n-grams and repetition

NGRAM = f"""
    d AS (SELECT doc_id, {PARAS.format('text')} AS ps FROM documents),
    p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM d),
    w AS (SELECT doc_id, k, p, {WS.format('p')} AS ws FROM p),
    g AS (SELECT DISTINCT doc_id, k, unnest(CASE WHEN len(ws) < 13 THEN [p] ELSE list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) END) AS s FROM w),
    f AS (SELECT doc_id, k, (min(doc_id * 1000000 + k) OVER (PARTITION BY s) < doc_id * 1000000 + k)::int AS seen FROM g),
    o AS (SELECT doc_id, k, sum(seen) / count(*) AS overlap FROM f GROUP BY 1, 2),
    a AS (SELECT doc_id, round(avg((overlap >= 0.5)::int), 4) AS r, round(avg(overlap), 4) AS m FROM o GROUP BY 1),
    n AS (SELECT doc_id, len(ps)::bigint AS para_count, coalesce(r, 0.0) AS para_contamination_ratio, coalesce(m, 0.0) AS mean_shingle_overlap, coalesce(r, 0.0) > 0 AS is_ngram_dup FROM d LEFT JOIN a USING (doc_id))"""


@query(f"WITH {NGRAM} SELECT * FROM n")
def ngram_dedup(spark, sf_dir):
    return dedup.ngram(documents(spark, sf_dir), sep=SEP)


@query(f"WITH {NGRAM} SELECT count(*) AS total_docs, sum(is_ngram_dup::int)::bigint AS contaminated_docs, round(avg(is_ngram_dup::int), 4) AS contaminated_pct, sum(para_count)::bigint AS total_paras FROM n")
def ngram_dedup_summary(spark, sf_dir):
    n = dedup.ngram(documents(spark, sf_dir), sep=SEP)
    return n.agg(F.count("*").alias("total_docs"), S.flagged("is_ngram_dup").alias("contaminated_docs"), S.share(S.flagged("is_ngram_dup"), F.count("*")).alias("contaminated_pct"), F.sum("para_count").alias("total_paras"))


_NAMES = [*dedup.REPETITION, *(f"top_{n}gram_fraction" for n in dedup.TOP_NGRAMS)]
_OVER = ", ".join(f"CASE WHEN {k} > {v} THEN '{k}' END" for k, v in {**dedup.REPETITION, **{f"top_{n}gram_fraction": v for n, v in dedup.TOP_NGRAMS.items()}}.items())
REPEAT = rf"""
    b AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: trim(x) <> ''), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS ls,
          list_transform(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> ''), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS ps,
          regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_\s]') AS t FROM documents),
    tk AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM b),
    gr AS (SELECT doc_id, {', '.join(f"md5(w{''.join(f' || chr(1) || lead(w, {k}) OVER o' for k in range(1, n))}) AS g{n}" for n in dedup.TOP_NGRAMS)} FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS ({' UNION ALL '.join(f"SELECT doc_id, {n} AS n, max(c) AS c FROM (SELECT doc_id, g{n}, count(*) AS c FROM gr WHERE g{n} IS NOT NULL GROUP BY 1, 2) GROUP BY 1" for n in dedup.TOP_NGRAMS)}),
    v AS (SELECT doc_id, {', '.join(f'max(c) FILTER (n = {n}) AS c{n}' for n in dedup.TOP_NGRAMS)} FROM g GROUP BY 1),
    x AS (SELECT doc_id, len(t)::bigint AS token_count,
          CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls))) / len(ls) ELSE 0.0 END AS duplicate_line_fraction,
          CASE WHEN len(ps) > 0 THEN (len(ps) - len(list_distinct(ps))) / len(ps) ELSE 0.0 END AS duplicate_paragraph_fraction,
          CASE WHEN len(ls) > 0 THEN (length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), ''))) / greatest(length(array_to_string(ls, '')), 1) ELSE 0.0 END AS duplicate_line_char_fraction,
          CASE WHEN len(ps) > 0 THEN (length(array_to_string(ps, '')) - length(array_to_string(list_distinct(ps), ''))) / greatest(length(array_to_string(ps, '')), 1) ELSE 0.0 END AS duplicate_paragraph_char_fraction,
          {', '.join(f'CASE WHEN len(t) < {2 * n} THEN 0.0 ELSE least(1.0, (c{n} - 1) * {n} / len(t)) END AS top_{n}gram_fraction' for n in dedup.TOP_NGRAMS)}
          FROM b LEFT JOIN v USING (doc_id)),
    y AS (SELECT doc_id, token_count, {', '.join(f'round({k}, 6) AS {k}' for k in _NAMES)}, array_to_string(list_filter([{_OVER}], lambda z: z IS NOT NULL), ',') AS triggered_thresholds FROM x)"""


@query(f"WITH {REPEAT} SELECT *, triggered_thresholds <> '' AS is_high_repetition FROM y")
def repetition_audit(spark, sf_dir):
    return dedup.repetition(documents(spark, sf_dir))


@query(f"WITH {REPEAT} SELECT threshold, count(*) AS docs FROM (SELECT unnest(string_split(triggered_thresholds, ',')) AS threshold FROM y WHERE triggered_thresholds <> '') GROUP BY 1")
def repetition_triggers(spark, sf_dir):
    r = dedup.repetition(documents(spark, sf_dir)).where("is_high_repetition")
    return S.distribution(r.select(F.explode(F.split("triggered_thresholds", ",")).alias("t")), F.col("t"), "threshold")


# ---------------------------------------------------------------- MinHash

_A, _B = dedup.permutations(64)
_SIG = ", ".join(f"min((h * {a} + {b}) % {dedup.PRIME})" for a, b in zip(_A, _B))
MINHASH = f"""
    w AS (SELECT doc_id, {_WS_TEXT} AS ws FROM documents), q AS (SELECT * FROM w WHERE len(ws) >= 9),
    h AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(array_to_string(ws[i:i + 4], ' ')), 1, 8))::bigint AS h FROM q, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
    s AS (SELECT doc_id, [{_SIG}] AS sig FROM h GROUP BY 1),
    bd AS (SELECT doc_id, i AS band, md5(array_to_string(sig[i * 8 + 1:i * 8 + 8], ',')) AS key FROM s, (SELECT unnest(range(0, 8)) AS i)),
    bk AS (SELECT band, key FROM bd GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 1000),
    cd AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bd x JOIN bk USING (band, key) JOIN bd y USING (band, key) WHERE x.doc_id < y.doc_id),
    pr AS (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64 AS jaccard FROM cd JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
    pp AS (SELECT * FROM pr WHERE jaccard >= 0.8)"""
CLUSTERS = f"""WITH RECURSIVE {MINHASH},
    e AS (SELECT a, b FROM pp UNION SELECT b, a FROM pp),
    reach(n, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
    c AS (SELECT n AS doc_id, min(r) AS root FROM reach GROUP BY 1),
    m AS (SELECT a AS doc_id, round(max(jaccard), 4) AS j, count(*) AS n FROM (SELECT a, b, jaccard FROM pp UNION ALL SELECT b, a, jaccard FROM pp) GROUP BY 1),
    k AS (SELECT doc_id, coalesce(j, 0.0) AS jaccard_max, coalesce(n, 0) AS near_dup_count, coalesce(root, doc_id) AS cluster_id FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)),
    z AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, near_dup_count > 0 AS is_near_dup FROM k)"""


@query(f"WITH {MINHASH} SELECT doc_id, md5(array_to_string(sig, ',')) AS signature FROM s")
def minhash_signature(spark, sf_dir):
    s = dedup.minhash_signatures(documents(spark, sf_dir))
    return s.select("doc_id", F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("signature"))


@query(f"WITH {MINHASH} SELECT doc_id, band::int AS band, key FROM bd")
def minhash_bands(spark, sf_dir):
    return dedup.bands(dedup.minhash_signatures(documents(spark, sf_dir)))


@query(f"WITH {MINHASH} SELECT * FROM pp")
def minhash_pairs(spark, sf_dir):
    """All pairs by the operator's definition with its bucket cap; ``minhash_links`` has none."""
    return dedup.minhash_pairs(dedup.written(dedup.minhash_signatures(documents(spark, sf_dir)), "signatures"), bucket_cap=1000)


@query(f"{CLUSTERS} SELECT * FROM z")
def minhash_clusters(spark, sf_dir):
    return dedup.minhash(documents(spark, sf_dir))


@query(f"{CLUSTERS} SELECT doc_id, CASE WHEN cluster_size >= 2 THEN cluster_id ELSE -1 END AS cluster_id, cluster_size, cluster_size - 1 AS near_dup_count, cluster_size >= 2 AS is_near_dup, cluster_size >= 2 AS in_multi_cluster FROM z")
def minhash_distributed(spark, sf_dir):
    return dedup.minhash_distributed(dedup.minhash(documents(spark, sf_dir)))


@query(f"{CLUSTERS} SELECT count(*) AS total_docs, sum(is_near_dup::int)::bigint AS near_dup_docs, round(avg(is_near_dup::int), 4) AS near_dup_pct, count(DISTINCT cluster_id) AS clusters, max(cluster_size) AS largest, round(pow(1 / 8, 1 / 8), 4) AS threshold_estimate FROM z")
def minhash_summary(spark, sf_dir):
    m = dedup.minhash(documents(spark, sf_dir))
    return m.agg(F.count("*").alias("total_docs"), S.flagged("is_near_dup").alias("near_dup_docs"), S.share(S.flagged("is_near_dup"), F.count("*")).alias("near_dup_pct"), F.countDistinct("cluster_id").alias("clusters"), F.max("cluster_size").alias("largest"), F.round(F.pow(F.lit(1 / 8), F.lit(1 / 8)), 4).alias("threshold_estimate"))


# ---------------------------------------------------------------- embeddings

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) AS v FROM embeddings)"
SEM = f"""WITH RECURSIVE {_UNIT},
    p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.v, b.v) AS c FROM u a JOIN u b ON b.vec_id < a.vec_id),
    n AS (SELECT i, max(c) AS c, arg_max(j, (round(c, 9), -j)) AS j FROM p GROUP BY 1),
    f AS (SELECT vec_id, coalesce(c, 0.0) AS c, CASE WHEN c >= 0.5 THEN j END AS parent FROM u LEFT JOIN n ON i = vec_id),
    t(vec_id, root) AS (SELECT vec_id, vec_id FROM f WHERE parent IS NULL UNION ALL SELECT f.vec_id, t.root FROM f JOIN t ON f.parent = t.vec_id)"""


@query(f"{SEM} SELECT f.vec_id, round(c, 4) AS max_cos, root AS cluster_root, count(*) OVER (PARTITION BY root) AS cluster_size, root = f.vec_id AS is_representative, root <> f.vec_id AS is_semantic_dup FROM f JOIN t USING (vec_id)")
def semdedup(spark, sf_dir):
    return dedup.semantic(table(spark, sf_dir, "embeddings"), eps=0.5)


_TOPK = f"WITH {_UNIT}, p AS (SELECT a.vec_id AS doc_id, b.vec_id AS item, b.label, round(list_inner_product(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.label <> 0 AND b.label = 0)"


@query(f"{_TOPK} SELECT doc_id, round(max(c), 4) AS cos_max, 'item_' || arg_min(item, (-c, 'item_' || item)) AS matched_bench_id, 'label0' AS matched_benchmark, array_to_string(list_transform(list_slice(list_sort(list(struct_pack(n := -c, i := 'item_' || item))), 1, 5), lambda x: x.i), ',') AS top_ids, max(c) >= 0.4 AS is_semantic_contaminated FROM p GROUP BY 1")
def embedding_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    items = e.where("label = 0").select(F.concat(F.lit("item_"), F.col("vec_id")).alias("bench_id"), F.lit("label0").alias("benchmark"), "embedding")
    return contamination.embed(e.where("label <> 0").select(F.col("vec_id").alias("doc_id"), "embedding"), items, threshold=0.4)


# ---------------------------------------------------------------- contamination

INDEX = f"""i AS (SELECT md5(t) AS hash, level, 'bench' AS labels FROM (
      SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, 'doc' AS level FROM benchmark UNION SELECT text, 'doc' FROM benchmark UNION SELECT unnest({PARAS.format('text')}), 'para' FROM benchmark) WHERE t <> '' GROUP BY ALL)"""
CONT = f"""WITH {INDEX}, d AS (SELECT doc_id, md5(text) AS doc_hash, {PARAS.format('text')} AS ps FROM documents),
    h AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, md5(unnest(ps)) AS h FROM d) JOIN i ON h = hash AND level = 'para' GROUP BY 1),
    c AS (SELECT doc_id, doc_hash, CASE WHEN hash IS NOT NULL OR n > 0 THEN 'bench' ELSE '' END AS matched_benchmarks, coalesce(n, 0) AS para_match_count,
          CASE WHEN len(ps) > 0 THEN round(coalesce(n, 0) / len(ps), 4) ELSE 0.0 END AS para_match_ratio, hash IS NOT NULL AS is_exact_contaminated, coalesce(n, 0) > 0 AS has_para_contamination
          FROM d LEFT JOIN i ON doc_hash = hash AND level = 'doc' LEFT JOIN h USING (doc_id))"""


@query(f"WITH {INDEX} SELECT * FROM i")
def bench_hash_index(spark, sf_dir):
    return contamination.hash_index(bench(spark, sf_dir), SEP)


@query(f"{CONT} SELECT * FROM c")
def contamination_exact(spark, sf_dir):
    return contamination.exact(documents(spark, sf_dir), bench(spark, sf_dir), SEP)


@query(f"{CONT} SELECT count(*) AS total_docs, sum(is_exact_contaminated::int)::bigint AS contaminated_docs, sum(has_para_contamination::int)::bigint AS para_docs, sum(para_match_count)::bigint AS para_matches FROM c")
def contamination_exact_summary(spark, sf_dir):
    c = contamination.exact(documents(spark, sf_dir), bench(spark, sf_dir), SEP)
    return c.agg(F.count("*").alias("total_docs"), S.flagged("is_exact_contaminated").alias("contaminated_docs"), S.flagged("has_para_contamination").alias("para_docs"), F.sum("para_match_count").alias("para_matches"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_verbatim(spark, sf_dir):
    """Items that stand in a document word by word."""
    return contamination.verbatim(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_AB = dedup.permutations(128)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _near_sql(windows: str, n_bands: int, rows: int, threshold: float) -> str:
    a, b = dedup.permutations(n_bands * rows)
    sig = ", ".join(f"min((h * {x} + {y}) % {dedup.PRIME})" for x, y in zip(a, b))
    gram = "CASE WHEN length(t) <= 5 THEN [t] ELSE list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) END"
    hashed = lambda src, keys: f"SELECT {keys}, [{sig}] AS sig FROM (SELECT DISTINCT {keys}, ('0x' || substr(md5(g), 1, 8))::bigint AS h FROM (SELECT {keys}, unnest({gram}) AS g FROM {src} WHERE t <> '')) GROUP BY {keys}"
    band = lambda src, keys: f"SELECT {keys}, i AS band, md5(array_to_string(sig[i * {rows} + 1:i * {rows} + {rows}], ',')) AS key FROM {src}, (SELECT unnest(range(0, {n_bands})) AS i)"
    return f"""WITH it AS (SELECT 'bench_' || item_id AS bench_id, {_STRIP.format('text')} AS t FROM benchmark), dw AS ({windows}),
    wi AS (SELECT doc_id, k, {_STRIP.format('t')} AS t FROM dw), si AS ({hashed('it', 'bench_id')}), sd AS ({hashed('wi', 'doc_id, k')}),
    cd AS (SELECT DISTINCT doc_id, k, bench_id FROM ({band('sd', 'doc_id, k')}) JOIN ({band('si', 'bench_id')}) USING (band, key)),
    j AS (SELECT doc_id, bench_id, len(list_filter(list_zip(sd.sig, si.sig), lambda z: z[1] = z[2])) / {n_bands * rows} AS j FROM cd JOIN sd USING (doc_id, k) JOIN si USING (bench_id)),
    b AS (SELECT doc_id, max(j) AS j, arg_min(bench_id, (-j, bench_id)) AS bench_id FROM j WHERE j > 0 GROUP BY 1),
    nr AS (SELECT d.doc_id, coalesce(round(j, 4), 0.0) AS jaccard_max, coalesce(bench_id, '') AS matched_bench_id, CASE WHEN j IS NULL THEN '' ELSE 'bench' END AS matched_benchmark,
           CASE WHEN j IS NULL THEN '' ELSE 'text' END AS matched_kind, CASE WHEN j IS NULL THEN '' ELSE 'bench=' || round(j, 4)::double::varchar END AS jaccard_max_per_benchmark, coalesce(j, 0.0) >= {threshold} AS is_near_contaminated FROM documents d LEFT JOIN b USING (doc_id))"""


_WINDOWS = f"SELECT doc_id, k, substr(s, (k * 150 + 1)::bigint, 300) AS t FROM (SELECT doc_id, s, unnest(range(0, ceil(greatest(length(s) - 300, 0) / 150)::bigint + 1)) AS k FROM (SELECT doc_id, {_STRIP.format('text')} AS s FROM documents))"
NEAR_W = _near_sql(_WINDOWS, 32, 4, 0.85)


@query(_near_sql(f"SELECT doc_id, 0 AS k, {_STRIP.format('text')} AS t FROM documents", 16, 8, 0.85) + " SELECT * FROM nr")
def contamination_near(spark, sf_dir):
    return contamination.near(documents(spark, sf_dir), bench(spark, sf_dir))


@query(f"{NEAR_W} SELECT * FROM nr")
def contamination_near_windows(spark, sf_dir):
    return contamination.near(documents(spark, sf_dir), bench(spark, sf_dir), n_bands=32, rows=4, window=300, stride=150)


def _vectors(spark, sf_dir):
    """Embeddings of documents and of items: those of the table, by id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    items = table(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("bench_id"), F.lit("bench").alias("benchmark"), "embedding")
    return v.select(F.col("vec_id").alias("doc_id"), "embedding"), items


def _layers(spark, sf_dir):
    d, b = documents(spark, sf_dir), bench(spark, sf_dir)
    l1 = contamination.written(contamination.exact(d, b, SEP), "l1")
    l2 = contamination.written(contamination.near(d, b, n_bands=32, rows=4, window=300, stride=150), "l2")
    vectors, items = _vectors(spark, sf_dir)
    l3 = contamination.embed(vectors, items, candidates=contamination.pending(l1, l2)).withColumnRenamed("cos_max", "cos")
    return contamination.cascade(l1, l2, l3, languages=d, english=("bench",), language="fr")


_CASCADE = NEAR_W + ", " + CONT.removeprefix("WITH ") + """,
    l AS (SELECT c.doc_id, is_exact_contaminated AS l1_doc_hit, has_para_contamination AS l1_para_hit, jaccard_max AS l2_jaccard_max, is_exact_contaminated OR has_para_contamination AS ex, matched_bench_id AS i2, matched_benchmark AS b2, nullif(matched_benchmarks, '') AS b1,
          NOT (is_exact_contaminated OR has_para_contamination) AND jaccard_max >= 0.2 AND jaccard_max < 0.85 AS l3_run FROM c JOIN nr ON nr.doc_id = c.doc_id),
    un AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) AS u FROM embeddings),
    cw AS (SELECT x.vec_id AS doc_id, 'bench_' || item_id AS item, round(list_sum(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2])), 6) AS w FROM un x, benchmark JOIN un y ON y.vec_id = item_id WHERE x.vec_id IN (SELECT doc_id FROM l WHERE l3_run)),
    cm AS (SELECT doc_id, max(w) AS w, arg_min(item, (-w, item)) AS item FROM cw GROUP BY 1),
    v AS (SELECT l.*, CASE WHEN l3_run THEN coalesce(round(w, 4), 0.0) ELSE 0.0 END AS l3_cos_max, CASE WHEN l3_run THEN item END AS i3, lang FROM l LEFT JOIN cm ON cm.doc_id = l.doc_id JOIN documents d ON d.doc_id = l.doc_id),
    cs AS (SELECT doc_id, l1_doc_hit, l1_para_hit, l2_jaccard_max, l3_cos_max, l3_run, ex AS is_exact_contaminated, l2_jaccard_max >= 0.85 AS is_near_contaminated, l3_run AND l3_cos_max >= 0.85 AS is_semantic_contaminated,
           CASE WHEN ex OR l2_jaccard_max >= 0.85 THEN 'red' WHEN l2_jaccard_max < 0.2 THEN 'green' WHEN l3_cos_max >= 0.85 THEN 'red' WHEN l3_cos_max >= 0.75 THEN 'yellow' ELSE 'green' END AS verdict,
           coalesce(i3, nullif(i2, ''), '') AS matched_bench_id, coalesce(b1, nullif(b2, ''), CASE WHEN i3 IS NOT NULL THEN 'bench' END, '') AS matched_benchmark, verdict <> 'green' AND lang = 'fr' AND matched_benchmark = 'bench' AS is_cross_lingual FROM v)"""


@query(f"{_CASCADE} SELECT * FROM cs")
def contamination_cascade(spark, sf_dir):
    return _layers(spark, sf_dir)


@query(f"{_CASCADE} SELECT verdict, count(*) AS docs, sum(l3_run::int)::bigint AS l3_runs FROM cs GROUP BY 1")
def cascade_summary(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("docs"), S.flagged("l3_run").alias("l3_runs"))


# ---------------------------------------------------------------- quality and extraction

_PHRASES, _TAG = "(?i)(?:" + "|".join(cleaning.PHRASES) + ")", cleaning.TAG
EXTRACT = r"""
    b AS (SELECT id AS doc_id, t, length(t) AS n, len(regexp_extract_all(t, '{tag}')) AS tags, len(regexp_extract_all(t, '{entity}')) AS entities, len(regexp_extract_all(t, '{md}')) AS md,
          len(regexp_extract_all(t, '{url}')) AS urls, length(t) - length(replace(t, chr(65533), '')) AS moji, regexp_extract_all(t, '{ph}') AS f, regexp_split_to_array(t, '{ph}') AS gaps FROM (SELECT {id} AS id, {text} AS t FROM {table})),
    h AS (SELECT doc_id, lower(f[k]) AS phrase, length(array_to_string(gaps[1:k], '')) + length(array_to_string(f[1:k - 1], '')) AS pos, n FROM (SELECT doc_id, f, gaps, n, unnest(range(1, len(f) + 1)) AS k FROM b)),
    m AS (SELECT doc_id, count(*) AS hits, sum(CASE WHEN pos >= e AND pos < greatest(n - e, e) THEN 1 ELSE 0 END) AS mid FROM (SELECT *, greatest(200, floor(n * 0.05)) AS e FROM h) GROUP BY 1),
    w AS (SELECT b.*, coalesce(hits, 0) AS hits, coalesce(hits - mid + mid * 0.2, 0)::double AS weighted FROM b LEFT JOIN m USING (doc_id)),
    r AS (SELECT *, tags >= 3 OR entities >= 1 AS html, n > 0 AND n < 50 AS short FROM w),
    s AS (SELECT *, (CASE WHEN short THEN 3 ELSE 0 END + CASE WHEN moji > 0 THEN 2 ELSE 0 END + CASE WHEN html THEN 2 ELSE 0 END + least(weighted / 2, 2))::double AS risk FROM r),
    x AS (SELECT doc_id, n::bigint AS char_count, tags::bigint AS html_tag_count, entities::bigint AS html_entity_count, md::bigint AS markdown_artifact_count, urls::bigint AS url_count, hits::bigint AS boilerplate_count,
          round(weighted, 3) AS boilerplate_weighted, moji::bigint AS mojibake_count, round(risk, 3) AS extraction_risk_score, html AS has_html_residue, weighted >= 2 AS has_boilerplate, moji > 0 AS has_mojibake,
          short AS too_short_stub, risk >= 2 AS low_extraction_quality FROM s)"""


def _extract(table_: str, id_: str, text: str) -> str:
    out = EXTRACT
    for k, v in {"tag": _TAG, "entity": cleaning.ENTITY, "md": cleaning.MARKDOWN, "url": cleaning.URL, "ph": _PHRASES, "table": table_, "id": id_, "text": text}.items():
        out = out.replace("{" + k + "}", v)
    return "WITH " + out


@query(_extract("documents", "doc_id", "text") + " SELECT * FROM x")
def extraction_documents(spark, sf_dir):
    return cleaning.extraction(documents(spark, sf_dir))


@query(_extract("pages", "page_id", "html") + " SELECT * FROM x")
def extraction_pages(spark, sf_dir):
    return cleaning.extraction(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query(_extract("documents", "doc_id", "text") + " SELECT phrase, count(*) AS hits FROM h GROUP BY 1")
def boilerplate_phrases(spark, sf_dir):
    return cleaning.phrase_counts(documents(spark, sf_dir))


GOPHER = r"""
    g AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]') AS ws, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents),
    g2 AS (SELECT *, len(ws) AS n, list_filter(ws, lambda w: regexp_matches(w, '[^[:punct:]…—–“”‘’«»、，。；：！？「」『』（）【】《》〈〉·～]')) AS rl FROM g),
    g3 AS (SELECT *, len(rl) AS m, length(array_to_string(rl, '')) / len(rl) AS av, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•*·‐‑–—►▶◆●○-]'))) AS bl,
           len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el, len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) AS al,
           len(list_intersect(list_transform(ws, lambda w: lower(w)), ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'])) AS st FROM g2),
    gq AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN m < 50 THEN 'too_few_words' WHEN m > 100000 THEN 'too_many_words' WHEN av < 3 THEN 'avg_word_too_short' WHEN av > 10 THEN 'avg_word_too_long'
           WHEN (length(text) - length(replace(text, '#', ''))) / n > 0.1 THEN 'too_many_hashes' WHEN ((length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', ''))) / n > 0.1 THEN 'too_many_ellipsis'
           WHEN bl > 0.9 * len(ls) THEN 'too_many_bullet_lines' WHEN el > 0.3 * len(ls) THEN 'too_many_ellipsis_lines' WHEN al / n < 0.6 THEN 'too_many_non_alpha_words'
           WHEN lang LIKE 'en%' AND st < 2 THEN 'not_enough_stop_words' END AS reason FROM g3)"""
C4 = r"""
    l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS k FROM documents),
    l2 AS (SELECT doc_id, k, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\[[0-9]*\]|\[edit\]|\[citation needed\]', '', 'g') AS line, list_filter(regexp_split_to_array(raw, '\s+'), lambda x: x <> '') AS ws FROM l),
    l3 AS (SELECT *, lower(line) AS low, len(ws) >= 3 AND len(list_filter(ws, lambda w: length(w) > 1000)) = 0 AND regexp_matches(line, '[.?!"'']$') AND NOT ends_with(line, '...') AS ok FROM l2),
    l4 AS (SELECT doc_id, k, CASE WHEN NOT ok THEN NULL WHEN contains(low, 'lorem ipsum') THEN 'lorem_ipsum' WHEN contains(low, 'javascript') THEN NULL WHEN contains(line, '{') THEN 'curly_bracket' END AS bad,
           CASE WHEN ok AND NOT contains(low, 'javascript') AND NOT regexp_matches(low, 'cookie policy|privacy policy|terms of use|use cookies|use of cookies|uses cookies')
                THEN len(list_filter(string_split(regexp_replace(line, '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) ELSE 0 END AS n FROM l3),
    cq AS (SELECT doc_id, coalesce(arg_min(bad, k) FILTER (bad IS NOT NULL), CASE WHEN sum(n) < 5 THEN 'too_few_sentences' END) AS reason FROM l4 GROUP BY 1)"""


@query(f"WITH {GOPHER} SELECT doc_id, reason IS NULL AS gopher_quality, reason AS gopher_quality_reason, reason IS NOT NULL AS any_filter_failed FROM gq")
def gopher_quality(spark, sf_dir):
    return cleaning.quality(documents(spark, sf_dir), ("gopher_quality",))


@query(f"WITH {C4} SELECT doc_id, reason IS NULL AS c4_quality, reason AS c4_quality_reason, reason IS NOT NULL AS any_filter_failed FROM cq")
def c4_quality(spark, sf_dir):
    return cleaning.quality(documents(spark, sf_dir), ("c4_quality",))


@query(f"WITH {GOPHER}, {C4} SELECT filter, reason, count(*) AS docs FROM (SELECT 'gopher_quality' AS filter, reason FROM gq UNION ALL SELECT 'c4_quality', reason FROM cq) WHERE reason IS NOT NULL GROUP BY 1, 2")
def quality_reasons(spark, sf_dir):
    q = cleaning.quality(documents(spark, sf_dir))
    r = q.select(F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f"{f}_reason").alias("reason")) for f in cleaning.FILTERS))).alias("x"))
    return r.where("x.reason IS NOT NULL").groupBy(F.col("x.filter").alias("filter"), F.col("x.reason").alias("reason")).agg(F.count("*").alias("docs"))


_PROFILE = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in p.split())}))) AS {k}" for k, p in cleaning.PROFILES.items())
_RANK = ", ".join(f"{{'n': -{k}, 'k': '{k}'}}" for k in cleaning.PROFILES)
LANG = rf"""
    lw AS (SELECT doc_id, lang AS language, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda w: regexp_replace(lower(w), '[.,;:!?]+$', '')) AS ws FROM documents),
    lc AS (SELECT doc_id, language, {_PROFILE} FROM lw),
    lr AS (SELECT doc_id, language, {' + '.join(cleaning.PROFILES)} AS total, list_sort([{_RANK}]) AS r FROM lc),
    li AS (SELECT doc_id, language, CASE WHEN total > 0 THEN r[1].k ELSE 'unknown' END AS lang, CASE WHEN total > 0 THEN round(-r[1].n / total, 4) ELSE 0.0 END AS confidence,
           CASE WHEN total > 0 THEN array_to_string(list_transform(r[1:3], lambda x: x.k), ',') ELSE '' END AS top3 FROM lr)"""


@query(f"WITH {LANG} SELECT doc_id, lang, confidence, top3, coalesce(language <> '' AND lower(language) <> lang, false) AS lang_mismatch, confidence < 0.5 AS low_confidence FROM li")
def langid_stopword(spark, sf_dir):
    return cleaning.langid(documents(spark, sf_dir))


@query(f"WITH {LANG} SELECT lang, count(*) AS docs FROM li GROUP BY 1")
def langid_distribution(spark, sf_dir):
    return S.distribution(cleaning.langid(documents(spark, sf_dir)), F.col("lang"), "lang")


_M = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cleaning.MACRO.items()) + " END"


@query(f"""WITH {LANG} SELECT doc_id, lang AS langid_lang, confidence AS langid_conf, coalesce({_M.format('lang')}, 'und') || '_Latn' AS glotlid_lang_script, confidence AS glotlid_conf, {_M.format('lang')} IS NOT NULL AS agree,
       false AS disagreement, false AS possibly_absorbed, confidence < 0.5 AS low_confidence FROM li""")
def langcross(spark, sf_dir):
    d = documents(spark, sf_dir)
    return cleaning.langcross(cleaning.langid(d), cleaning.glotlid(d))


# ---------------------------------------------------------------- personal data, secrets, toxicity

_PII_SQL = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, unnest(regexp_extract_all(text, '{p}')) AS v, {str(c).lower()} AS luhn FROM documents" for e, p, c in safety.PII)
_IPS = "list_transform(string_split(v, '.'), lambda x: x::int)"
PII = rf"""
    ph AS ({_PII_SQL}),
    pl AS (SELECT *, list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN NOT luhn THEN 0 WHEN i % 2 = 0 THEN (CASE WHEN substr(reverse(v), i, 1)::int > 4 THEN substr(reverse(v), i, 1)::int * 2 - 9 ELSE substr(reverse(v), i, 1)::int * 2 END) ELSE substr(reverse(v), i, 1)::int END)) % 10 = 0 AS ok FROM ph),
    pv AS (SELECT doc_id, entity, v, CASE WHEN entity = 'IP_ADDRESS' THEN {_IPS} END AS o, lower(regexp_extract(v, '@([^@]*)$', 1)) AS dom, lower(regexp_extract(v, '^(.*)@[^@]*$', 1)) AS loc FROM pl WHERE ok OR NOT luhn),
    pp_ AS (SELECT doc_id, entity, md5(v) AS value_md5, CASE WHEN entity = 'EMAIL_ADDRESS' THEN dom IN ({', '.join(repr(x) for x in safety.PLACEHOLDER_DOMAINS)}) OR regexp_matches(dom, '\.(test|example|invalid|localhost)$') OR loc IN ({', '.join(repr(x) for x in safety.PLACEHOLDER_LOCALS)})
            WHEN entity = 'IP_ADDRESS' THEN regexp_matches(v, '(^|\.)0[0-9]') OR list_max(o) > 255 OR o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19)) OR regexp_matches(v, '^(192\.0\.[02]|198\.51\.100|203\.0\.113)\.')
            ELSE false END AS placeholder FROM pv)"""


@query(f"WITH {PII} SELECT * FROM pp_")
def pii_hits(spark, sf_dir):
    return safety.pii_hits(documents(spark, sf_dir))


@query(f"WITH {PII}, k AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT entity, ',' ORDER BY entity) AS e FROM pp_ WHERE NOT placeholder GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS pii_count, coalesce(e, '') AS entities, n IS NOT NULL AS has_pii FROM documents LEFT JOIN k USING (doc_id)")
def pii_audit(spark, sf_dir):
    return safety.pii(documents(spark, sf_dir))


@query(f"WITH {PII} SELECT entity, count(*) AS hits, sum(placeholder::int)::bigint AS placeholders FROM pp_ GROUP BY 1")
def pii_summary(spark, sf_dir):
    return safety.pii_hits(documents(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("hits"), S.flagged("placeholder").alias("placeholders"))


_SECRET = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, line_no, unnest(regexp_extract_all(line, '{}', {})) AS v, {} AS least FROM l".format(r, p.replace("'", "''"), g, e) for r, p, g, e in safety.SECRETS)


@query(f"""WITH {_LIC}, sh AS ({_SECRET}), sc AS (SELECT row_number() OVER () AS id, * FROM sh), ch AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(v, '')) AS c FROM sc) GROUP BY 1, 2),
       en AS (SELECT id, round(-sum(n / t * log2(n / t)), 4) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM ch) GROUP BY 1)
       SELECT doc_id, rule, line_no::bigint AS line_no, entropy FROM sc JOIN en USING (id) WHERE entropy >= least""")
def secret_hits(spark, sf_dir):
    return safety.secret_hits(documents(spark, sf_dir))


TOX = rf"""
    cw AS (SELECT doc_id, {_WS_TEXT} AS ws FROM documents),
    ck AS (SELECT doc_id, k AS chunk_idx, ws[k * 448 + 1:k * 448 + 512] AS c FROM (SELECT doc_id, ws, unnest(range(0, ceil(greatest(len(ws) - 512, 0) / 448)::bigint + 1)) AS k FROM cw)),
    sc AS (SELECT doc_id, chunk_idx, round(1 - pow(0.5, len(list_filter(c, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g') IN ({', '.join(repr(w) for w in safety.LEXICON)})))), 4) AS score FROM ck),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_idx) AS r FROM sc),
    tx AS (SELECT doc_id, max(score) AS xlmr_max, round(avg(score), 4) AS xlmr_mean, count(*) AS n_chunks, count(*) FILTER (score >= 0.5) AS n_chunks_recalled, count(*) FILTER (score >= 0.8 AND r <= 8) AS n_chunks_promote,
           count(*) FILTER (score >= 0.5 AND score < 0.8 AND r <= 8) AS n_chunks_discuss FROM rk GROUP BY 1)"""


@query(f"WITH {TOX} SELECT *, n_chunks_recalled > 0 AS recalled, n_chunks_promote > 0 AS llm_promote, n_chunks_recalled > 0 AND n_chunks_promote > 0 AS high_risk FROM tx")
def toxicity_routing(spark, sf_dir):
    return safety.toxicity(documents(spark, sf_dir))


_REPLY = "CASE doc_id % 5 WHEN 0 THEN 'so: {{\"verdict\": \"Promote\", \"confidence\": 0.91234, \"reason\": \"r' || doc_id || '\"}} done' WHEN 1 THEN 'no json' WHEN 2 THEN '' WHEN 3 THEN '{{\"verdict\": \"other\", \"confidence\": \"x\"}}' ELSE '{{\"verdict\": \"discuss\"}}' END".replace("{{", "{").replace("}}", "}")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'promote' WHEN 4 THEN 'discuss' ELSE 'benign' END AS verdict, CASE doc_id % 5 WHEN 0 THEN 0.9123 ELSE 0.0 END AS confidence,
       CASE doc_id % 5 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 'parse_error' WHEN 2 THEN 'empty' ELSE '' END AS reason FROM documents""")
def judge_parse(spark, sf_dir):
    r = documents(spark, sf_dir).select("doc_id", F.expr(_REPLY).alias("raw"))
    return r.select("doc_id", safety.judged_json(F.col("raw")).alias("j")).select("doc_id", "j.*")


# ---------------------------------------------------------------- tokens and domains


@query(r"""WITH b AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::bigint AS token_count, length(text)::bigint AS char_count FROM documents)
       SELECT doc_id, token_count, char_count, CASE WHEN char_count > 0 THEN round(token_count / char_count, 6) ELSE 0.0 END AS fertility, CASE WHEN char_count > 0 THEN token_count / char_count > 0.5 ELSE false END AS high_fertility FROM b""")
def tokenization_fertility(spark, sf_dir):
    return tokenization.tokenize(documents(spark, sf_dir)).select("doc_id", "token_count", "char_count", "fertility", "high_fertility")


@query(r"""WITH b AS (SELECT lang AS language, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) / length(text) AS f FROM documents WHERE length(text) > 0)
       SELECT language, count(*) AS docs, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.95), 6) AS p95 FROM b GROUP BY 1""")
def tokenization_by_language(spark, sf_dir):
    d = documents(spark, sf_dir).where("length(text) > 0").select("language", (tokenization.word_tokens(F.col("text")) / F.length("text")).alias("f"))
    return d.groupBy("language").agg(F.count("*").alias("docs"), F.round(F.avg("f"), 6).alias("mean"), F.round(F.percentile("f", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("f", F.lit(0.95)), 6).alias("p95"))


@query(r"""WITH b AS (SELECT doc_id, text AS t, regexp_extract_all(text, '(?s)```.*?```') AS c, list_concat(regexp_extract_all(text, '(?s)\$\$.*?\$\$'), regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$', '', 'g'), '\$\$+', chr(1), 'g'), '\$[^$\n\x01]+\$'),
       regexp_extract_all(text, '(?s)\\begin\{[^}]+\}.*?\\end\{[^}]+\}')) AS l FROM documents),
       n AS (SELECT doc_id, length(array_to_string(c, ''))::bigint AS code_char_count, length(array_to_string(l, ''))::bigint AS latex_char_count, len(regexp_extract_all(array_to_string(c, chr(10)), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::bigint AS code_token_count,
             len(regexp_extract_all(array_to_string(l, chr(10)), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::bigint AS latex_token_count FROM b)
       SELECT *, coalesce(round(code_token_count / nullif(code_char_count, 0), 6), 0.0) AS code_fertility, coalesce(round(latex_token_count / nullif(latex_char_count, 0), 6), 0.0) AS latex_fertility FROM n""")
def code_latex_spans(spark, sf_dir):
    return tokenization.tokenize(documents(spark, sf_dir)).select("doc_id", "code_char_count", "code_token_count", "code_fertility", "latex_char_count", "latex_token_count", "latex_fertility")


@query()
def parsability_python(spark, sf_dir):
    return domain.parsability(documents(spark, sf_dir), F.lit("python"))


_STEM_REPLY = "concat(CAST(doc_id % 1100 AS STRING), '.5,x\\nb\\nc\\nd\\ne\\nf\\ng\\n', CASE WHEN doc_id % 7 = 0 THEN 'skip' ELSE CAST(doc_id % 6 AS STRING) END, ',1\\ni\\n', CAST(doc_id % 4 AS STRING))"


@query("""WITH r AS (SELECT doc_id, (doc_id % 1100)::varchar || '.5' AS fdc_raw, (substr((doc_id % 1100)::varchar, 1, 3)::bigint // 100) * 100 AS c, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 6 END AS reasoning_depth, doc_id % 4 AS educational_level FROM documents)
       SELECT doc_id, fdc_raw, c AS fdc_top_class, CASE c """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in domain.LABELS.items()) + """ END AS fdc_top_label, reasoning_depth, educational_level, c IN (0, 500, 600) AS is_stem, coalesce(reasoning_depth >= 4, false) AS high_difficulty, false AS parse_failed FROM r""")
def stem_parse(spark, sf_dir):
    return domain.stem(documents(spark, sf_dir).select("doc_id", F.expr(_STEM_REPLY).alias("reply")))


@query("SELECT doc_id, round((1 + doc_id % 7) / (2 + doc_id % 5), 6) AS binoculars, (1 + doc_id % 7) / (2 + doc_id % 5) < 0.9 AS is_ai_generated FROM documents")
def binoculars_threshold(spark, sf_dir):
    d = documents(spark, sf_dir)
    return domain.binoculars(d.select("doc_id", (1 + F.col("doc_id") % 7).cast("double").alias("nll"), (2 + F.col("doc_id") % 5).cast("double").alias("cross_entropy")))


@query()
def config_audit(spark, sf_dir):
    return domain.config_audit(spark, [("yaml", "reset_position_ids: true\ntrain:\n  reset_attention_mask: yes\n  eod_mask_loss: 1\n"), ("flags", "--reset-position-ids --seq-length 4096"), ("json", '{"eod_mask_loss": false}')])


# ---------------------------------------------------------------- comparison statistics, over recipes = sources

_SCORES = "sc AS (SELECT source AS recipe, round(avg(length(text)), 6) AS proxy, round(avg(len(string_split(text, ' '))), 6) AS target FROM documents GROUP BY 1)"
_PAIRS = f"WITH {_SCORES}, pr AS (SELECT a.recipe AS l, b.recipe AS r, a.proxy - b.proxy AS dp, a.target - b.target AS dt FROM sc a JOIN sc b ON a.recipe < b.recipe)"


def _scores(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.col("source").alias("recipe")).agg(F.round(F.avg(F.length("text")), 6).alias("proxy"), F.round(F.avg(F.size(F.split("text", " "))), 6).alias("target"))


@query(f"{_PAIRS}, x AS (SELECT * FROM pr WHERE abs(dt) > 0) SELECT count(*) AS pair_count, sum((dp * dt > 0)::int)::bigint AS correct, sum((dp * dt < 0)::int)::bigint AS incorrect, sum((dp = 0)::int)::bigint AS proxy_ties, round(sum((dp * dt > 0)::int) / count(*), 6) AS accuracy FROM x")
def pairwise_agreement(spark, sf_dir):
    return decisions.pairwise_agreement(_scores(spark, sf_dir))


@query(f"""{_PAIRS}, k AS (SELECT sum((dp * dt > 0)::int)::bigint AS concordant, sum((dp * dt < 0)::int)::bigint AS discordant, sum((dp = 0 AND dt <> 0)::int)::bigint AS left_ties, sum((dp <> 0 AND dt = 0)::int)::bigint AS right_ties FROM pr)
       SELECT *, round((concordant - discordant) / sqrt((concordant + discordant + left_ties) * (concordant + discordant + right_ties)), 6) AS tau_b FROM k""")
def kendall_tau(spark, sf_dir):
    return decisions.kendall_tau_b(_scores(spark, sf_dir))


@query(f"""WITH {_SCORES}, sd AS (SELECT ((doc_id // 20) % 2)::varchar AS seed, source AS recipe, round(avg(length(text)), 6) AS proxy FROM documents GROUP BY 1, 2), ok AS (SELECT recipe FROM sd GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT seed) FROM sd)),
       pr AS (SELECT a.recipe AS l, b.recipe AS r, a.target - b.target AS dt FROM sc a JOIN sc b ON a.recipe < b.recipe WHERE a.recipe IN (FROM ok) AND b.recipe IN (FROM ok) AND a.target <> b.target),
       m AS (SELECT l, r, dt, min(sign(x.proxy - y.proxy)) AS lo, max(sign(x.proxy - y.proxy)) AS hi FROM pr JOIN sd x ON x.recipe = l JOIN sd y ON y.recipe = r AND x.seed = y.seed GROUP BY 1, 2, 3),
       g AS (SELECT count(*) AS pair_count, sum((lo = hi AND lo <> 0 AND lo = sign(dt))::int)::bigint AS correct, sum((lo = hi AND lo <> 0 AND lo <> sign(dt))::int)::bigint AS incorrect, sum((lo <> hi OR lo = 0)::int)::bigint AS abstained FROM m)
       SELECT *, round((correct + incorrect) / pair_count, 6) AS coverage, CASE WHEN correct + incorrect > 0 THEN round(correct / (correct + incorrect), 6) END AS conditional_accuracy FROM g""")
def seed_stability(spark, sf_dir):
    seeds = documents(spark, sf_dir).groupBy((F.floor(F.col("doc_id") / 20) % 2).cast("string").alias("seed"), F.col("source").alias("recipe")).agg(F.round(F.avg(F.length("text")), 6).alias("proxy"))
    return decisions.seed_stability(seeds, _scores(spark, sf_dir).select("recipe", "target"))


@query("""WITH p AS (SELECT source AS name, round((1 + count(*) FILTER (length(text) > 2000)) / (1 + count(*)), 6) AS p_value FROM documents GROUP BY 1),
       r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, name) AS raw FROM p)
       SELECT name, p_value, round(least(1.0, min(raw) OVER (ORDER BY p_value DESC, name DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r""")
def bh_adjust(spark, sf_dir):
    p = documents(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.round((1 + F.count_if(F.length("text") > 2000)) / (1 + F.count("*")), 6).alias("p_value"))
    return decisions.benjamini_hochberg(p)


_MC = """mc AS (SELECT doc_id AS example_id, lang AS grp, [-1.0 * (1 + doc_id % 7), -1.0 * (1 + doc_id % 5), -1.0 * (1 + doc_id % 3)] AS ll, [1 + doc_id % 2, 2, 3] AS tk, [2 + doc_id % 3, 4, 5] AS ch, (doc_id % 3)::int AS gold FROM documents),
    pc AS (SELECT *, [ll[1] / ch[1], ll[2] / ch[2], ll[3] / ch[3]] AS p FROM mc), bt AS (SELECT *, list_max(p) AS best, p[gold + 1] AS g, list_max(list_filter([CASE WHEN gold <> 0 THEN p[1] END, CASE WHEN gold <> 1 THEN p[2] END, CASE WHEN gold <> 2 THEN p[3] END], lambda x: x IS NOT NULL)) AS wr FROM pc),
    ti AS (SELECT *, len(list_filter(p, lambda x: abs(x - best) <= 1e-12)) AS tied FROM bt),
    mm AS (SELECT example_id, grp, round(CASE WHEN g >= best - 1e-12 THEN 1.0 ELSE 0.0 END / tied, 6) AS accuracy, round(exp(g), 6) AS correct_prob_per_char, round(exp(g - best) / (exp(p[1] - best) + exp(p[2] - best) + exp(p[3] - best)), 6) AS normalized_choice_probability,
           round(g - wr, 6) AS margin, round(ll[gold + 1] / tk[gold + 1], 6) AS logprob_per_token, CASE WHEN tied > 1 THEN 1.0 ELSE 0.0 END AS choice_tie FROM ti)"""


def _choices(spark, sf_dir):
    i = F.col("doc_id")
    dbl = lambda *xs: F.array(*(x.cast("double") for x in xs))
    d = documents(spark, sf_dir).select(i.alias("example_id"), F.col("language").alias("grp"), dbl(-(1 + i % 7), -(1 + i % 5), -(1 + i % 3)).alias("loglik"), dbl(1 + i % 2, F.lit(2), F.lit(3)).alias("tokens"), dbl(2 + i % 3, F.lit(4), F.lit(5)).alias("chars"), (i % 3).cast("int").alias("gold"))
    return decisions.choice_metrics(d)


@query(f"WITH {_MC} SELECT * FROM mm")
def mc_choice_metrics(spark, sf_dir):
    return _choices(spark, sf_dir)


@query(f"WITH {_MC} SELECT (SELECT round(avg(accuracy), 6) FROM mm) AS micro, round(avg(a), 6) AS macro, count(*) AS n_groups FROM (SELECT grp, avg(accuracy) AS a FROM mm GROUP BY 1)")
def mc_micro_macro(spark, sf_dir):
    return decisions.micro_macro(_choices(spark, sf_dir))


@query()
def bootstrap_ci(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("source").alias("name"), F.col("doc_id").alias("example_id"), F.cos(F.col("doc_id").cast("double")).alias("diff"))
    return decisions.paired_intervals(d)


_SHARDS = "SELECT source AS shard, 'total_docs' AS metric, count(*)::double AS value FROM documents GROUP BY 1 UNION ALL SELECT source, 'short_docs', count(*) FILTER (length(text) < 500)::double FROM documents GROUP BY 1 UNION ALL SELECT source, 'threshold', 0.5 FROM documents GROUP BY 1"


@query(f"SELECT metric, sum(value) AS value, count(*) AS n_shards FROM ({_SHARDS}) WHERE metric <> 'threshold' GROUP BY 1")
def shard_merge(spark, sf_dir):
    s = documents(spark, sf_dir).groupBy(F.col("source").alias("shard")).agg(F.count("*").cast("double").alias("total_docs"), F.count_if(F.length("text") < 500).cast("double").alias("short_docs"), F.lit(0.5).alias("threshold"))
    return merge.merged(merge.long_form(s, "shard"))


@query("""WITH m AS (SELECT quality, avg(length(text)) AS chars, avg((length(text) < 500)::int) AS short FROM documents JOIN labels USING (doc_id) GROUP BY 1),
       x AS (SELECT 'stats' AS dim, 'chars' AS metric, max(chars) FILTER (quality = 1) AS p, max(chars) FILTER (quality = 0) AS n, true AS h FROM m UNION ALL SELECT 'stats', 'short', max(short) FILTER (quality = 1), max(short) FILTER (quality = 0), false FROM m)
       SELECT dim, metric, round(p, 6) AS positive, round(n, 6) AS negative, CASE WHEN abs(round(p, 6) - round(n, 6)) / greatest(abs(round(p, 6)), abs(round(n, 6)), 1e-12) < 0.05 THEN 'TIE' WHEN (h AND p > n) OR (NOT h AND p < n) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x""")
def control_compare(spark, sf_dir):
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.round(F.avg(F.length("text")), 6).alias("chars"), F.round(F.avg((F.length("text") < 500).cast("int")), 6).alias("short"))
    m = merge.long_form(d, "quality").withColumn("dim", F.lit("stats"))
    expected = spark.createDataFrame([("stats", "chars", True), ("stats", "short", False)], "dim string, metric string, higher_is_better boolean")
    return merge.control_compare(m.where("quality = 1"), m.where("quality = 0"), expected)


from . import extended  # noqa: E402, F401 - registers further queries

"""Personal data, secrets and toxicity, by rule tables and pluggable scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

#: entity, pattern (in the common subset of Java and RE2), whether digits must pass the Luhn check.
PII = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", False),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", False),
    ("CREDIT_CARD", r"\b[0-9]{13,16}\b", True),
    ("PHONE_NUMBER", r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}-[0-9]{4}", False),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", False),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", False),
    ("CRYPTO", r"\b(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{26,34}|0x[0-9a-fA-F]{40})\b", False),
    ("IN_AADHAAR", r"\b[2-9][0-9]{3} [0-9]{4} [0-9]{4}\b", False),
    ("IN_PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", False),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b", False),
    ("URL", r"https?://[^ \t\n\r\"<>]+", False),
    ("US_BANK_NUMBER", r"(?i)\baccount (?:no\.?|number):? [0-9]{8,17}\b", False),
    ("US_PASSPORT", r"(?i)\bpassport (?:no\.?|number):? [A-Z]?[0-9]{8,9}\b", False),
)
#: Addresses of the sixth version that belong to nobody: unspecified, loopback, link-local, private, documentation.
OWN_IPV6 = r"(?i)^(?:0{0,4}:)*:?0{0,3}[01]$|^fe[89ab][0-9a-f]:|^f[cd][0-9a-f]{2}:|^2001:0?db8:"
PLACEHOLDER_DOMAINS = "acme.com company.com domain.com email.com example.com example.edu example.net example.org foo.bar foo.com localhost localhost.localdomain mydomain.com sample.com test.com yourdomain.com".split()
PLACEHOLDER_LOCALS = "abc admin anyone bar contact do-not-reply donotreply email example first.last firstname.lastname foo info jane jane.doe janedoe john john.doe johndoe lastname.firstname me name no-reply nobody noreply placeholder somebody someone test user username xyz you your your-email your_email youremail yourname".split()
SECRETS = (
    ("generic-token", r"(?i)\b(?:token|secret|password|api[_-]?key)\b *[=:] *[\"']([A-Za-z0-9_/+=-]{16,})[\"']", 1, 3.0),
    ("aws-access-key", r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b", 1, 2.5),
    ("github-token", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", 1, 3.0),
    ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 0.0),
    ("slack-token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 2.5),
)
VERDICTS = ("benign", "discuss", "promote")


def luhn(c: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    digits = F.transform(F.split(F.reverse(c), ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    digits = F.filter(digits, lambda x: x.isNotNull())
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def is_placeholder(entity: Column, value: Column) -> Column:
    """Sample addresses and addresses that belong to nobody: documentation, private, reserved and malformed ones."""
    local, domain = F.lower(F.regexp_extract(value, r"^(.*)@[^@]*$", 1)), F.lower(F.substring_index(value, "@", -1))
    mail = F.instr(value, "@") > 0
    mail = mail & (domain.isin(PLACEHOLDER_DOMAINS) | domain.rlike(r"\.(test|example|invalid|localhost)$") | local.isin(PLACEHOLDER_LOCALS))
    o = [F.try_element_at(F.split(value, r"\."), F.lit(i)).cast("int") for i in range(1, 5)]
    plain = value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~value.rlike(r"(^|\.)0[0-9]")
    bad = F.greatest(*o) > 255
    a, b = o[0], o[1]
    own = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127) & F.lit(False)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19)) | value.rlike(r"^(192\.0\.[02]|198\.51\.100|203\.0\.113)\.")
    return F.when(entity == "EMAIL_ADDRESS", mail).when(entity == "IP_ADDRESS", F.when(plain, bad | own).when(F.contains(value, F.lit(":")), value.rlike(OWN_IPV6)).otherwise(F.lit(True))).otherwise(F.lit(False))


def pii_hits(docs: DataFrame) -> DataFrame:
    """``doc_id, entity, value_md5, placeholder``; the value itself is never given out."""
    def of(entity: str, pattern: str, check: bool) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(entity).alias("entity"), v.alias("v"), F.lit(check).alias("luhn")))

    hits = F.concat(*(of(*rule) for rule in PII))
    h = docs.where("text IS NOT NULL").select("doc_id", F.explode(hits).alias("h")).where(~F.col("h.luhn") | luhn(F.col("h.v")))
    return h.select("doc_id", F.col("h.entity").alias("entity"), F.md5("h.v").alias("value_md5"), is_placeholder(F.col("h.entity"), F.col("h.v")).alias("placeholder"))


def pii(docs: DataFrame) -> DataFrame:
    """Per document: number of real hits and whether there is one."""
    n = pii_hits(docs).where("NOT placeholder").groupBy(F.col("doc_id").alias("d2")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("e"))
    out = docs.select("doc_id").join(n, F.col("doc_id") == F.col("d2"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("pii_count"), F.coalesce("e", F.lit("")).alias("entities"), F.col("n").isNotNull().alias("has_pii"))


def secret_hits(docs: DataFrame) -> DataFrame:
    """``doc_id, rule, line_no, entropy`` of candidates whose entropy reaches their rule's."""
    line = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))

    def of(rule: str, pattern: str, group: int, least: float) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("v"), F.lit(least).alias("least")))

    hits = F.concat(*(of(*rule) for rule in SECRETS))
    h = line.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), F.explode(hits).alias("h"))
    return h.select("doc_id", F.col("h.rule").alias("rule"), "line_no", F.round(T.entropy(F.col("h.v")), 4).alias("entropy"), F.col("h.least").alias("least")).where("entropy >= least").drop("least")


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """``doc_id, chunk_idx, text`` of white-space token windows; an empty text is one empty chunk."""
    step = max(1, size - max(0, overlap))
    ws = docs.select("doc_id", T.words(F.col("text")).alias("ws"))
    last = F.ceil(F.greatest(F.size("ws") - size, F.lit(0)) / step).cast("int")
    c = ws.select("doc_id", "ws", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    return c.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.array_join(F.slice("ws", F.col("chunk_idx") * step + 1, size), " ").alias("text"))


LEXICON = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "trash")


def lexicon_score(text: Column) -> Column:
    """Stand-in recall score: 1 less the share left by each listed word."""
    n = F.size(F.filter(T.words(F.lower(text)), lambda w: F.regexp_replace(w, "[^a-z]", "").isin(*LEXICON)))
    return F.round(1 - F.pow(F.lit(0.5), n), 4)


def toxicity(docs: DataFrame, scorer=lexicon_score, judge=None, recall_from: float = 0.5, top_k: int = 8, promote_from: float = 0.8, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks are scored, the best ``top_k`` recalled ones judged, verdicts gathered by document.

    ``scorer(text)`` and ``judge(text, score)`` build columns; the judge gives a verdict.
    It sees the recalled chunks only.
    """
    judge = judge or (lambda text, score: F.when(score >= promote_from, "promote").when(score >= recall_from, "discuss").otherwise("benign"))
    s = chunks(docs, size, overlap).withColumn("score", scorer(F.col("text")))
    r = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_idx"))
    s = s.withColumn("r", r).withColumn("recalled", F.col("score") >= recall_from)
    s = s.withColumn("verdict", F.when(F.col("recalled") & (F.col("r") <= top_k), judge(F.col("text"), F.col("score"))))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = s.groupBy("doc_id").agg(F.max("score").alias("xlmr_max"), F.round(F.avg("score"), 4).alias("xlmr_mean"), F.count("*").alias("n_chunks"), n(F.col("recalled")).alias("n_chunks_recalled"), n(F.col("verdict") == "promote").alias("n_chunks_promote"), n(F.col("verdict") == "discuss").alias("n_chunks_discuss"))
    return g.select("*", (F.col("n_chunks_recalled") > 0).alias("recalled"), (F.col("n_chunks_promote") > 0).alias("llm_promote"), ((F.col("n_chunks_recalled") > 0) & (F.col("n_chunks_promote") > 0)).alias("high_risk"))


def judged_json(raw: Column, verdicts: tuple[str, ...] = VERDICTS, default: str = "benign", reason_chars: int = 120) -> Column:
    """struct(verdict, confidence, reason) from a judge's reply; what can't be read is the default at 0."""
    found = F.regexp_extract(raw, r"(?s)\{[^{}]*\}", 0)
    body = F.when(found != "", found).otherwise(raw)
    ok = F.try_parse_json(body).isNotNull() & body.rlike(r"^\s*\{")
    get = lambda k: F.get_json_object(body, f"$.{k}")
    v = F.lower(T.strip(F.coalesce(get("verdict"), F.lit(default))))
    v = F.when(v.isin(*verdicts), v).otherwise(default)
    conf = F.round(F.coalesce(F.expr("1D") * get("confidence").try_cast("double"), F.lit(0.0)), 4)
    empty = F.coalesce(raw == "", F.lit(True))
    return F.struct(F.when(empty | ~ok, default).otherwise(v).alias("verdict"), F.when(empty | ~ok, 0.0).otherwise(conf).alias("confidence"), F.when(empty, "empty").when(~ok, "parse_error").otherwise(F.substring(F.coalesce(get("reason"), F.lit("")), 1, reason_chars)).alias("reason"))

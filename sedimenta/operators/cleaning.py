"""Rule-based text quality, extraction residue and language identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..ship import ship

PUNCT = "".join(sorted("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…—–“”‘’«»、，。；：！？「」『』（）【】《》〈〉·～"))
BULLETS = "•*·‐‑–—►▶◆●○-"
STOPS_EN = ("and", "be", "have", "of", "that", "the", "to", "with")
STOPS_ZH = ("不", "了", "和", "在", "是", "有", "的", "这")
POLICIES = ("cookie policy", "privacy policy", "terms of use", "use cookies", "use of cookies", "uses cookies")
POLICIES_CJK = ("cookie", "使用条款", "隐私政策")
TAGS = (
    "a address article aside audio blockquote body br button canvas caption center col colgroup dd details div dl dt fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe img input label legend li link main meta nav noscript ol optgroup option p picture pre script section select span "
    "style svg table tbody td textarea tfoot th thead title tr ul video"
).split()
TAG = rf"(?i)</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?:\s[^<>]*)?/?>"
ENTITY = r"&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);"
MARKDOWN = r"!?\[[^\]]*\]\([^)]*\)"
URL = r"https?://[^\s<>\"]+"
PHRASES = ("accept cookies", "all rights reserved", "click here", "cookie policy", "log in", "privacy policy", "read more", "sign in", "sign up", "skip to (?:main )?content", "subscribe to our newsletter", "terms of service", "terms of use", "we use cookies")
PHRASES_ZH = ("上一页", "下一页", "保留所有权利", "免责声明", "关注我们", "扫描二维码", "服务条款", "未经授权", "未经许可", "点击这里", "版权所有", "转载请注明", "阅读更多", "隐私政策")
#: Stop words by language of the stand-in identifier.
PROFILES = {
    "en": "the and of to is in that for with was on as by are this be from or an at it",
    "fr": "le la les et des un une est dans que qui pour pas sur avec au du ce se en",
    "de": "der die das und ist von zu den mit sich des auf für nicht ein eine im dem als",
    "es": "el la los las y de que en un una por con para es del se al como no su",
}


#: The filters by name: a function of (text, language) to the first rule that fails, else none.
FILTERS = {"gopher_quality": R.gopher(PUNCT, BULLETS, STOPS_EN, STOPS_ZH), "c4_quality": R.c4(POLICIES, POLICIES_CJK)}


def quality(docs: DataFrame, filters: tuple[str, ...] = tuple(FILTERS), default_language: str = "en") -> DataFrame:
    """Per document and filter: passed or not, and the reason; unknown filters are an error."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    ship(docs.sparkSession)
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{f}_reason string" for f in filters)])
    out = docs.select("doc_id", "text", "language").mapInArrow(R.reasons({f: FILTERS[f] for f in filters}, default_language), schema)
    failed = F.lit(False)
    for f in filters:
        failed = failed | F.col(f"{f}_reason").isNotNull()
    return out.select("doc_id", *(c for f in filters for c in (F.col(f"{f}_reason").isNull().alias(f), f"{f}_reason")), failed.alias("any_filter_failed"))


def boilerplate_hits(text: Column) -> Column:
    """array<struct<phrase, at>> of stock phrases with their 0-based character place."""
    out = []
    for p in (rf"(?i)(?:{'|'.join(PHRASES)})", "|".join(PHRASES_ZH)):
        found = F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))
        gaps = F.split(text, p)
        at = F.transform(found, lambda x, k: F.struct(F.lower(x).alias("phrase"), F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda s, g: s + F.length(g)).alias("g"), F.aggregate(F.slice(found, 1, k), F.lit(0), lambda s, g: s + F.length(g)).alias("m")))  # noqa: B023
        out.append(F.transform(at, lambda x: F.struct(x["phrase"].alias("phrase"), (x["g"] + x["m"]).alias("at"))))
    return F.concat(*out)


def extraction(docs: DataFrame, short_stub_chars: int = 50, min_tags: int = 3, min_entities: int = 1, edge_ratio: float = 0.05, edge_chars: int = 200, middle: float = 0.2, boilerplate_from: float = 2.0, risk_from: float = 2.0) -> DataFrame:
    """Per document: what an extraction should have left out, and the weighted risk of it."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    base = docs.select("doc_id", n.alias("n"), T.matches(text, TAG).alias("tags"), T.matches(text, ENTITY).alias("entities"), T.matches(text, MARKDOWN).alias("md"), T.matches(text, URL).alias("urls"), T.count_of(text, "�").alias("moji"), F.when(text.rlike(rf"(?i)(?:{'|'.join(PHRASES)})|{'|'.join(PHRASES_ZH)}"), boilerplate_hits(text)).alias("hits"))
    edge = F.greatest(F.lit(edge_chars), F.floor(F.col("n") * edge_ratio).cast("int"))
    inner = lambda h: (h["at"] >= edge) & (h["at"] < F.greatest(F.col("n") - edge, edge))
    n_hits = F.coalesce(F.size("hits"), F.lit(0))
    mid = F.coalesce(F.size(F.filter("hits", inner)), F.lit(0))
    df = base.withColumn("n_hits", n_hits).withColumn("weighted", (F.col("n_hits") - mid) + mid * F.lit(middle))
    html = (F.col("tags") >= min_tags) | (F.col("entities") >= min_entities)
    short = (F.col("n") > 0) & (F.col("n") < short_stub_chars)
    risk = F.when(short, 3.0).otherwise(0.0) + F.when(F.col("moji") > 0, 2.0).otherwise(0.0) + F.when(html, 2.0).otherwise(0.0) + F.least(F.col("weighted") / 2, F.lit(2.0))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return df.select(
        "doc_id", long("n", "char_count"), long("tags", "html_tag_count"), long("entities", "html_entity_count"), long("md", "markdown_artifact_count"), long("urls", "url_count"), long("n_hits", "boilerplate_count"),
        F.round("weighted", 3).alias("boilerplate_weighted"), long("moji", "mojibake_count"), F.round(risk, 3).alias("extraction_risk_score"),
        html.alias("has_html_residue"), (F.col("weighted") >= boilerplate_from).alias("has_boilerplate"), (F.col("moji") > 0).alias("has_mojibake"), short.alias("too_short_stub"), (risk >= risk_from).alias("low_extraction_quality"),
    )


def phrase_counts(docs: DataFrame) -> DataFrame:
    """``phrase, hits`` over all documents."""
    return docs.select(F.explode(boilerplate_hits(F.coalesce("text", F.lit("")))).alias("h")).groupBy(F.col("h.phrase").alias("phrase")).agg(F.count("*").alias("hits"))


def langid(docs: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Stand-in identifier: share of stop words by language; ``lang, confidence, top3`` and flags.

    Ties go to the language first in the alphabet; a text without stop words is ``unknown``.
    """
    return _identified(_counted(docs, False), min_confidence)


def _counted(docs: DataFrame, scripts: bool) -> DataFrame:
    """(doc_id, language) with stop words by language and, if asked for, the script of most letters and whether there is a word at all; one walk over each text."""
    ship(docs.sparkSession)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select("doc_id", "language").schema]
    more = ["script string", "blank boolean"] if scripts else []
    return docs.select("doc_id", "language", F.col("text").cast("string").alias("text")).mapInArrow(R.languages(PROFILES, SCRIPTS if scripts else ()), ", ".join([*fields, *(f"{k} long" for k in PROFILES), *more]))


def _identified(df: DataFrame, min_confidence: float, *more: str) -> DataFrame:
    total = sum((F.col(k) for k in PROFILES), F.lit(0))
    ranked = F.sort_array(F.array(*(F.struct((-F.col(k)).alias("n"), F.lit(k).alias("k")) for k in PROFILES)))
    df = df.select("doc_id", "language", *more, total.alias("total"), ranked.alias("r"))
    conf = F.when(F.col("total") > 0, F.round(-F.col("r")[0]["n"] / F.col("total"), 4)).otherwise(0.0)
    lang = F.when(F.col("total") > 0, F.col("r")[0]["k"]).otherwise("unknown")
    top3 = F.array_join(F.transform(F.slice("r", 1, 3), lambda x: x["k"]), ",")
    return df.select("doc_id", *more, lang.alias("lang"), conf.alias("confidence"), F.when(F.col("total") > 0, top3).otherwise("").alias("top3"), F.coalesce((F.col("language") != "") & (F.lower("language") != lang), F.lit(False)).alias("lang_mismatch"), (conf < min_confidence).alias("low_confidence"))


SCRIPTS = (("Hani", r"\p{IsHan}"), ("Hira", r"[\p{IsHiragana}\p{IsKatakana}]"), ("Hang", r"\p{IsHangul}"), ("Cyrl", r"\p{IsCyrillic}"), ("Arab", r"\p{IsArabic}"), ("Deva", r"\p{IsDevanagari}"), ("Grek", r"\p{IsGreek}"), ("Latn", r"\p{IsLatin}"))
MACRO = dict(zip("en fr de es zh ja ko ru ar it pt nl sv no nb nn da fi pl cs sk sl hr bs sr uk be bg ro hu el tr he yi fa ur hi bn ta te mr gu pa kn ml th vi id ms tl lo km my ka hy az kk uz mn ne si sw am ha yo ig zu xh af sq et lv lt is ga cy eu ca gl la eo".split(), "eng fra deu spa zho jpn kor rus ara ita por nld swe nor nor nor dan fin pol ces slk slv hbs hbs hbs ukr bel bul ron hun ell tur heb yid fas urd hin ben tam tel mar guj pan kan mal tha vie msa msa tgl lao khm mya kat hye aze kaz uzb mon nep sin swa amh hau yor ibo zul xho afr sqi est lav lit isl gle cym eus cat glg lat epo".split()))


def glotlid(docs: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Stand-in fine identifier: ``lang_script, confidence, top3``; empty text is ``und``.

    The script is that of most letters; the language that of ``langid`` where the
    script is Latin, else the script's own.
    """
    own = {"Hani": "zho", "Hira": "jpn", "Hang": "kor", "Cyrl": "rus", "Arab": "ara", "Deva": "hin", "Grek": "ell"}
    df = _identified(_counted(docs, True), min_confidence, "script", "blank")
    macro = F.create_map(*(F.lit(x) for kv in MACRO.items() for x in kv))
    mine = F.create_map(*(F.lit(x) for kv in own.items() for x in kv))
    latin = F.col("script") == "Latn"
    code = F.when(latin, F.coalesce(F.try_element_at(macro, F.col("lang")), F.lit("und"))).otherwise(F.try_element_at(mine, F.col("script")))
    none = F.col("blank") | F.col("script").isNull()
    conf = F.when(none, 0.0).when(latin, F.col("confidence")).otherwise(1.0)
    return df.select("doc_id", F.when(none, "und").otherwise(F.concat_ws("_", code, "script")).alias("lang_script"), conf.alias("confidence"), F.when(none, "").otherwise(F.col("top3")).alias("top3"), (conf < min_confidence).alias("low_confidence"))


def langcross(coarse: DataFrame, fine: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Join of both identifiers' results: agreement of macro-languages, and languages the coarse one doesn't know.

    An unknown macro-language agrees with nothing; it is a disagreement where the fine
    identifier is sure of a language.
    """
    macro = F.create_map(*(F.lit(x) for kv in MACRO.items() for x in kv))
    a = coarse.select("doc_id", F.col("lang").alias("langid_lang"), F.col("confidence").alias("langid_conf"))
    b = fine.select(F.col("doc_id").alias("d2"), F.col("lang_script").alias("glotlid_lang_script"), F.col("confidence").alias("glotlid_conf"))
    df = a.join(b, a.doc_id == b.d2)
    ma, mb = F.try_element_at(macro, F.col("langid_lang")), F.nullif(F.substring_index("glotlid_lang_script", "_", 1), F.lit("und"))
    sure = F.col("glotlid_conf") >= min_confidence
    agree = F.coalesce(ma == mb, F.lit(False))
    known = F.array(*(F.lit(v) for v in MACRO.values()))
    return df.select(
        "doc_id", "langid_lang", "langid_conf", "glotlid_lang_script", "glotlid_conf", agree.alias("agree"), (~agree & sure & mb.isNotNull()).alias("disagreement"),
        F.coalesce(sure & mb.isNotNull() & ~F.array_contains(known, mb), F.lit(False)).alias("possibly_absorbed"), ((F.col("langid_conf") < min_confidence) | ~sure).alias("low_confidence"),
    )

"""Column builders for text: words, lines, paragraphs, shingles, windows, counts.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"^\s+|\s+$"
#: Languages written without spaces between words, by prefix of the tag.
CJK = r"^(zh|cmn|yue|wuu|nan|ja|jpn|ko|kor)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def words(c: Column) -> Column:
    """What white space separates; none for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def pieces(c: Column) -> Column:
    """Runs of word characters, and every other visible character on its own; in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def lines(c: Column) -> Column:
    """Lines without their ends; a last line feed opens no further line."""
    return F.split(F.regexp_replace(c, r"\n$", ""), "\n")


def paragraphs(c: Column, sep: str, min_chars: int) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip)
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def upto(n: Column) -> Column:
    """``[1 .. n]``; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def shingles(ws: Column, n: int, whole: Column | None = None) -> Column:
    """Word n-grams; fewer than ``n`` words are one shingle (``whole``, by default the words joined)."""

    def of(w: Column) -> Column:
        few = F.array_join(w, " ") if whole is None else whole
        grams = F.transform(upto(F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.array(few)).otherwise(grams)

    return let(ws, of)


def is_cjk(c: Column, least: float = 0.3) -> Column:
    """Whether more than ``least`` of the characters are Chinese, Japanese or Korean."""
    return cjk_share(c) > least


def any_shingles(c: Column, n: int) -> Column:
    """Word n-grams; of a text that is mostly CJK, character 5n-grams without spaces, line feeds and tabs.  A shorter text is one."""
    bare = F.translate(c, " \n\t", "")

    def of(t: Column) -> Column:
        grams = F.transform(upto(F.length(t) - (5 * n - 1)), lambda i: F.substring(t, i, F.lit(5 * n)))
        return F.when(F.length(t) < 5 * n, F.array(t)).otherwise(grams)

    return F.when(is_cjk(c), let(bare, of)).otherwise(shingles(words(c), n))


def char_ngrams(c: Column, n: int) -> Column:
    """Character n-grams of the stripped text; a shorter one is one gram."""

    def of(chars: Column) -> Column:
        grams = F.transform(upto(F.size(chars) - (n - 1)), lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.size(chars) <= n, F.array(F.array_join(chars, ""))).otherwise(grams)

    return let(F.filter(F.split(strip(c), ""), lambda x: x != ""), of)


def windows(c: Column, size: int, stride: int) -> Column:
    """Character windows of the stripped text: one every ``stride``, until one reaches the end."""

    def of(t: Column) -> Column:
        last = F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / stride).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(t, k * stride + 1, F.lit(size)))

    return let(strip(c), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cjk_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^\\u3000-\\u9fff\\uac00-\\ud7af]", "")) / F.length(c)).otherwise(0.0)


def is_cjk_language(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(CJK), F.lit(False))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a fixed string that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def length_bucket(tokens: Column) -> Column:
    out = F.lit("<4k")
    for least, name in ((4000, "4k-8k"), (8000, "8k-32k"), (32000, "32k-128k"), (128000, "128k-256k"), (256000, ">=256k")):
        out = F.when(tokens >= least, name).otherwise(out)
    return out


def url_domain(url: Column) -> Column:
    """Network location with user and port; labels for no URL and for none within it."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.when(url.isNull() | (url == ""), "(no_url)").when(host == "", "(empty_netloc)").otherwise(host)


def parsed_timestamp(c: Column) -> Column:
    """One of three formats, else null."""
    out = [F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(*out)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of a string."""

    def of(chars: Column) -> Column:
        terms = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
        return F.aggregate(terms, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return let(F.filter(F.split(c, ""), lambda x: x != ""), of)

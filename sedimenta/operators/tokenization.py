"""Cost of tokenization: tokens by text, code and formula spans."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..ship import ship

FENCE = r"(?s)```.*?```"
DISPLAY = r"(?s)\$\$.*?\$\$"
INLINE = r"(?<!\$)\$(?!\$)[^$\n]+\$(?!\$)"
ENVIRONMENT = r"(?s)\\begin\{[^}]+\}.*?\\end\{[^}]+\}"


def code_spans(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(FENCE), F.lit(0))


def latex_spans(c: Column) -> Column:
    """Display formulas, inline ones of what is left, environments of the whole."""
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    return F.concat(every(c, DISPLAY), every(F.regexp_replace(c, DISPLAY, ""), INLINE), every(c, ENVIRONMENT))


def word_tokens(c: Column) -> Column:
    """Stand-in token count: words and single symbols."""
    return T.matches(c, r"(?U)\w+|[^\w\s]")


def hf_tokens(path: str):
    """Token counts by a ``tokenizers`` file that every worker can read."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for s in parts:
            yield pd.Series([len(e.ids) for e in tok.encode_batch(s.fillna("").tolist(), add_special_tokens=False)])

    return count


def unknown_id(path: str) -> int | None:
    """The id of the tokenizer's unknown token: the first of the usual names that it has."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return next((i for i in map(tok.token_to_id, ("[UNK]", "<unk>", "<UNK>")) if i is not None), None)


def hf_unknown(path: str):
    """Counts of unknown tokens, as ``tokenize`` takes them."""
    unk = unknown_id(path)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for s in parts:
            yield pd.Series([0 if unk is None else e.ids.count(unk) for e in tok.encode_batch(s.fillna("").tolist(), add_special_tokens=False)])

    return count


def tokenize(docs: DataFrame, count=word_tokens, unknown: Column | None = None, unk_threshold: float = 0.01, fertility_threshold: float = 0.5) -> DataFrame:
    """Per document: tokens and characters of the text, its code and its formulas, and their ratios."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    join = lambda spans: F.array_join(spans, "\n")
    chars = lambda spans: F.aggregate(spans, F.lit(0), lambda s, x: s + F.length(x)).cast("long")
    d = docs.select("doc_id", text.alias("t"), code_spans(text).alias("code"), latex_spans(text).alias("latex"), (F.lit(0) if unknown is None else unknown).cast("long").alias("unk_count"))
    d = d.select("doc_id", count(F.col("t")).cast("long").alias("token_count"), F.length("t").cast("long").alias("char_count"), "unk_count", chars(F.col("code")).alias("code_char_count"), F.when(F.size("code") > 0, count(join(F.col("code")))).otherwise(0).cast("long").alias("code_token_count"), chars(F.col("latex")).alias("latex_char_count"), F.when(F.size("latex") > 0, count(join(F.col("latex")))).otherwise(0).cast("long").alias("latex_token_count"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    fert, unk = ratio("token_count", "char_count"), ratio("unk_count", "token_count")
    return d.select("*", F.round(fert, 6).alias("fertility"), F.round(unk, 6).alias("unk_rate"), F.round(ratio("code_token_count", "code_char_count"), 6).alias("code_fertility"), F.round(ratio("latex_token_count", "latex_char_count"), 6).alias("latex_fertility"), (unk > unk_threshold).alias("high_unk_rate"), (fert > fertility_threshold).alias("high_fertility"))


def stats_and_tokens(docs: DataFrame, count=word_tokens, extra: dict[str, Column] | None = None) -> DataFrame:
    """Document statistics and token costs in one pass over the documents; ``extra`` adds columns of the caller's own."""
    more = {k: v for k, v in (extra or {}).items()}
    d = docs.select("*", F.struct("source", "url", "language", "timestamp", *(v.alias(k) for k, v in more.items())).alias("__own"))
    ws = F.size(T.words(F.col("text"))).cast("long")
    cost = tokenize(d.withColumn("doc_id", F.struct("doc_id", ws.alias("ws"), "__own")), count).withColumnRenamed("token_count", "tokenizer_count")
    own = cost.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.ws").alias("token_count"), "doc_id.__own", *(c for c in cost.columns if c != "doc_id"))
    blank = lambda c: F.coalesce(F.col(f"__own.{c}") == "", F.lit(True)).alias(f"missing_{c}")
    return own.select(F.col("__id").alias("doc_id"), "token_count", T.length_bucket(F.col("token_count")).alias("length_bucket"), *(blank(c) for c in ("timestamp", "url", "language", "source")), *(c for c in cost.columns if c != "doc_id"), *(F.col(f"__own.{k}").alias(k) for k in more))

"""Code parsability, subject classes, machine-written text and training configurations."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..ship import ship

ALIASES = {"c#": "c-sharp", "c++": "cpp", "csharp": "c-sharp", "cxx": "cpp", "golang": "go", "js": "javascript", "node": "javascript", "py": "python", "python3": "python", "rb": "ruby", "rs": "rust", "sh": "bash", "shell": "bash", "ts": "typescript"}
#: Languages that have a grammar of their own.
GRAMMARS = ("c", "c-sharp", "cpp", "go", "java", "javascript", "php", "python", "ruby", "rust", "typescript")
LABELS = {0: "computing and general works", 100: "philosophy and psychology", 200: "religion", 300: "social sciences", 400: "language", 500: "natural sciences and mathematics", 600: "technology", 700: "arts and recreation", 800: "literature", 900: "history and geography"}
STEM = (0, 500, 600)


@F.pandas_udf(types.StructType([types.StructField("errors", types.LongType()), types.StructField("nodes", types.LongType())]))
def _parsed(code: pd.Series) -> pd.DataFrame:
    out = []
    for c in code:
        try:
            out.append((0, sum(1 for _ in ast.walk(ast.parse(c or "")))))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            out.append((1, max(1, len((c or "").splitlines()))))
    return pd.DataFrame(out, columns=["errors", "nodes"])


def code_language(docs: DataFrame, default: str = "python") -> Column:
    """A document's programming language: ``meta.lang``, else ``meta.language``, else ``language``, else the default; aliases by their usual name."""
    some = lambda c: F.nullif(T.strip(c), F.lit(""))
    own = [some(F.get_json_object("meta", f"$.{k}")) for k in ("lang", "language")] if "meta" in docs.columns else []
    raw = F.lower(F.coalesce(*own, some(F.col("language")) if "language" in docs.columns else F.lit(None).cast("string"), F.lit(default)))
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, raw), raw)


def parsability(docs: DataFrame, language: Column | None = None) -> DataFrame:
    """Python only: syntax errors by nodes; other languages are unsupported, empty code is unparsable (an error).

    Texts of other languages aren't parsed.
    """
    ship(docs.sparkSession)
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    raw = F.lower(T.strip(F.coalesce(language, F.lit("python")))) if language is not None else None
    lang = code_language(docs) if raw is None else F.coalesce(F.try_element_at(names, raw), raw)
    d = docs.select("doc_id", lang.alias("lang"), "text").withColumn("ok", F.col("lang") == "python")
    d = d.select("doc_id", "lang", "ok", (F.coalesce(T.strip(F.col("text")), F.lit("")) == "").alias("blank"), _parsed(F.when(F.col("ok"), F.col("text"))).alias("p"))
    e = F.when(~F.col("ok"), 0).when(F.col("blank"), 1).otherwise(F.col("p.errors")).cast("long")
    n = F.when(~F.col("ok"), 0).when(F.col("blank"), 1).otherwise(F.col("p.nodes")).cast("long")
    return d.select("doc_id", "lang", e.alias("error_node_count"), n.alias("total_node_count"), F.when(n > 0, F.round(e / n, 6)).otherwise(0.0).alias("error_ratio"), (e > 0).alias("has_error"), (~F.col("ok")).alias("unsupported_lang"))


def begin_middle_end(c: Column, most: int = 30000) -> Column:
    """Long texts as their first, middle and last thirds of ``most`` characters."""
    k, mid = most // 3, F.floor(F.length(c) / 2).cast("int")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.lit("[beginning]\n"), F.substring(c, 1, k), F.lit("\n[middle]\n"), F.substring(c, mid - k // 2 + 1, F.lit(2 * (k // 2))), F.lit("\n[end]\n"), F.right(c, F.lit(k))))


def stem(replies: DataFrame) -> DataFrame:
    """``replies(doc_id, reply)`` of the classifier to its classes: Dewey class, label, depth, level, flags."""
    ls = F.filter(F.transform(F.split("reply", "\n"), T.strip), lambda x: x != "")
    d = replies.select("doc_id", ls.alias("ls"))
    first = lambda i: F.nullif(T.strip(F.substring_index(F.try_element_at("ls", F.lit(i + 1)), ",", 1)), F.lit(""))
    primary = lambda i: F.when(F.lower(first(i)) != "skip", first(i))
    top = (F.floor(F.nullif(F.regexp_extract(primary(0), "^([0-9]{1,3})", 1), F.lit("")).cast("int") / 100) * 100).cast("long")
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in (int(kv[0]), kv[1])))
    d = d.select("doc_id", primary(0).alias("fdc_raw"), top.alias("fdc_top_class"), primary(7).try_cast("long").alias("reasoning_depth"), primary(9).try_cast("long").alias("educational_level"))
    c = F.col("fdc_top_class")
    return d.select("doc_id", "fdc_raw", "fdc_top_class", F.try_element_at(labels, c.cast("int")).alias("fdc_top_label"), "reasoning_depth", "educational_level", F.coalesce(c.isin(*STEM), F.lit(False)).alias("is_stem"), F.coalesce(F.col("reasoning_depth") >= 4, F.lit(False)).alias("high_difficulty"), c.isNull().alias("parse_failed"))


def binoculars(scores: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``scores(doc_id, nll, cross_entropy)`` of two models: their ratio; below the threshold is machine-written."""
    s = F.when(F.col("cross_entropy") > 0, F.col("nll") / F.col("cross_entropy"))
    return scores.select("doc_id", F.round(s, 6).alias("binoculars"), F.coalesce(s < threshold, F.lit(False)).alias("is_ai_generated"))


PARAMETERS = ("reset_position_ids", "reset_attention_mask", "eod_mask_loss")


def parsed_config(content: str) -> dict[str, object]:
    """Flat settings of a YAML, JSON or command-line text; nested keys by their path and by their last part."""
    data = None
    try:
        import yaml

        data = yaml.safe_load(content)
    except Exception:  # noqa: BLE001 - any text may come
        data = None
    if not isinstance(data, dict):
        try:
            data = json.loads(content)
        except ValueError:
            data = None
    if not isinstance(data, dict):
        data = {m[1]: True for m in re.finditer(r"--([\w-]+)(?=\s|$)", content)}
        data |= {m[1]: m[2] for m in re.finditer(r"--?([\w-]+)[ =]+([^\s-][^\s]*)", content)}
        data |= {m[1]: m[2] for m in re.finditer(r"(?m)^\s*([\w-]+)\s*[:=]\s*(\S+)\s*$", content)}
    flat: dict[str, object] = {}

    def walk(x: dict, path: str) -> None:
        for k, v in x.items():
            if isinstance(v, dict):
                walk(v, f"{path}{k}.")
            else:
                flat[f"{path}{k}"] = v
                flat.setdefault(str(k), v)

    walk(data, "")
    return flat


def as_bool(v: object) -> object:
    s = str(v).strip().strip("'\"").lower()
    return True if s in ("true", "yes", "on", "1") else False if s in ("false", "no", "off", "0") else v


def config_audit(spark, contents: list[tuple[str, str]]) -> DataFrame:
    """(name, content) of configurations: one row for each required parameter; files are few and small."""
    rows = []
    for name, content in contents:
        flat = {k.lstrip("-").replace("-", "_"): v for k, v in parsed_config(content).items()}
        for p in PARAMETERS:
            v = as_bool(flat[p]) if p in flat else None
            rows.append((name, p, p in flat, None if v is None else str(v), v is True))
    df = spark.createDataFrame(rows, "name string, parameter string, found boolean, value string, valid boolean")
    return df


def stem_by_source(stems: DataFrame, docs: DataFrame) -> DataFrame:
    """``source, fdc_top_label, docs, share``: classes within each source, by source and then most frequent first."""
    j = stems.select("doc_id", F.coalesce("fdc_top_label", F.lit("(none)")).alias("fdc_top_label")).join(docs.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source")), "doc_id")
    g = j.groupBy("source", "fdc_top_label").agg(F.count("*").alias("docs"))
    total = g.groupBy(F.col("source").alias("s2")).agg(F.sum("docs").alias("n"))
    return g.join(total, F.col("source") == F.col("s2")).select("source", "fdc_top_label", "docs", F.round(F.col("docs") / F.col("n"), 4).alias("share")).orderBy("source", F.desc("docs"), "fdc_top_label")

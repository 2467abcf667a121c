"""Documents from JSON lines or Parquet, benchmarks from files, samples."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..ship import ship

FIELDS = ("doc_id", "text", "source", "url", "timestamp", "language", "meta")


def raw(spark: SparkSession, path: str, fmt: str = "auto", glob: str | None = None) -> DataFrame:
    """A file or a folder (recursively), as JSON lines or Parquet; by suffix if ``auto``."""
    if fmt == "auto":
        fmt = "jsonl" if (glob or path).endswith((".jsonl", ".json")) else "parquet"
    if fmt not in ("jsonl", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path) if fmt == "parquet" else reader.option("mode", "FAILFAST").json(path)


def normalised(df: DataFrame, rename: dict[str, str] | None = None, path_meta: dict[str, dict[str, str]] | None = None, strict: bool = True) -> DataFrame:
    """The seven fields: ids as text, unknown columns in ``meta`` (JSON), nulls filled from the file's path.

    With ``strict``, a blank id or a null text is an error that names the file; else such rows are dropped.
    """
    located = "_metadata" not in df.columns and any(True for _ in df.inputFiles()[:1])
    where = F.col("_metadata.file_path") if located else F.lit("")
    df = df.select("*", where.alias("__path")).withColumnsRenamed(rename or {})
    kinds = dict(df.dtypes)
    have = lambda c: F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")
    extras = [c for c in df.columns if c not in FIELDS and c != "__path"]
    meta = F.to_json(F.struct(*extras)) if extras else F.lit("{}")
    if "meta" in kinds:
        own = F.col("meta") if kinds["meta"] == "string" else F.to_json("meta")
        meta = F.when(own.isNull() | (own == "{}"), meta).when(F.lit(not extras) | (meta == "{}"), own).otherwise(F.concat(F.regexp_replace(own, r"\}\s*$", ","), F.substring(meta, 2, 1 << 30)))
    fields = {c: have(c) for c in FIELDS if c != "meta"}
    for c, rules in (path_meta or {}).items():
        if rules:
            guess = reduce(lambda w, kv: w.when(F.contains("__path", F.lit(kv[0])), F.lit(kv[1])), list(rules.items())[1:], F.when(F.contains("__path", F.lit(next(iter(rules)))), F.lit(next(iter(rules.values())))))
            fields[c] = F.coalesce(fields[c], guess)
    bad = fields["doc_id"].isNull() | (F.trim(fields["doc_id"]) == "") | fields["text"].isNull()
    if strict:
        fields["doc_id"] = F.when(bad, F.raise_error(F.concat(F.lit("a document without id or text in "), F.col("__path")))).otherwise(fields["doc_id"])
    else:
        df = df.where(~bad)
    return df.select(*(fields[c].alias(c) for c in FIELDS if c != "meta"), meta.alias("meta"))


def corpus(spark: SparkSession, *paths: str, fmt: str = "auto", glob: str | None = None, rename: dict[str, str] | None = None, path_meta: dict[str, dict[str, str]] | None = None, strict: bool = True) -> DataFrame:
    """All inputs as documents, one after the other."""
    return reduce(DataFrame.unionByName, (normalised(raw(spark, p, fmt, glob), rename, path_meta, strict) for p in paths))


def _items(content: str, fmt: str) -> Iterator[tuple[int, dict]]:
    """(number, record) of a benchmark file: JSON lines (blank ones counted), or a list, a map of records, or one record."""
    if fmt == "jsonl":
        for k, line in enumerate(content.split("\n")):
            if line.strip():
                yield k, json.loads(line)
        return
    data = json.loads(content)
    if isinstance(data, dict):
        data = list(data.values()) if data and all(isinstance(v, dict) for v in data.values()) else [data]
    yield from enumerate(data)


def benchmark(spark: SparkSession, path: str, label: str, text_field: str, code_field: str | None = None, fmt: str = "auto") -> DataFrame:
    """(bench_id, benchmark, text, code) of a file; ids are the label and a running number in the file's order.

    A file of JSON is read as one value by one task: benchmarks are small.
    """
    if not text_field:
        raise ValueError("text_field is required")
    if fmt == "auto":
        fmt = "jsonl" if path.endswith(".jsonl") else "json" if path.endswith(".json") else "parquet"
    if fmt == "parquet":
        df = spark.read.parquet(path)
        n = F.row_number().over(W.partitionBy("__path").orderBy("__row")) - 1  # within a file, by its own row numbers
        df = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")).withColumn("__k", n)
        text, code = F.col(text_field).cast("string"), (F.col(code_field) if code_field else F.lit(None)).cast("string")
        return df.select(F.concat(F.lit(f"{label}_"), F.col("__k").cast("string")).alias("bench_id"), F.lit(label).alias("benchmark"), text.alias("text"), code.alias("code"))
    as_text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def parse(batches):
        for pdf in batches:
            rows = [(f"{label}_{k}", label, as_text(r.get(text_field)), as_text(r.get(code_field)) if code_field else None) for c in pdf["value"] for k, r in _items(c, fmt)]
            yield pd.DataFrame(rows, columns=["bench_id", "benchmark", "text", "code"])

    ship(spark)
    return spark.read.text(path, wholetext=True).mapInPandas(parse, "bench_id string, benchmark string, text string, code string")


def registry(*benchmarks: DataFrame, specs: dict[str, dict] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """All benchmarks as one table: given ones, and ``specs`` (label to ``path, text_field[, code_field, format]``)."""
    loaded = list(benchmarks)
    for label, spec in (specs or {}).items():
        if not spec.get("path"):
            raise ValueError(f"benchmark {label!r} has no path")
        loaded.append(benchmark(spark, spec["path"], label, spec.get("text_field", ""), spec.get("code_field"), spec.get("format", "auto")))
    if not loaded:
        raise ValueError("no benchmark")
    return reduce(DataFrame.unionByName, loaded)


def unified(df: DataFrame, question: str, options: str | list[str] | None = None, answer: str | None = None, subject: str | None = None, code: str | None = None, id_field: str | None = None) -> DataFrame:
    """A source of questions in the common form: ``id, question, options, answer, subject, code``; the rows' own order names them if nothing else does."""
    some = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    opts = F.array(*(F.col(o).cast("string") for o in options)) if isinstance(options, list) else F.transform(F.col(options), lambda x: x.cast("string")) if options else F.array().cast("array<string>")
    return df.select((F.col(id_field).cast("string") if id_field else F.md5(F.col(question).cast("string"))).alias("id"), some(question).alias("question"), opts.alias("options"), some(answer).alias("answer"), some(subject).alias("subject"), some(code).alias("code"))


def summaries(spark: SparkSession, base: str) -> DataFrame:
    """``shard, metric, key, value`` of every ``summary.json`` below ``base``, its own aside: numbers in long form.

    Nested values are named by their path (``metric`` the first part, ``key`` the rest,
    null for a plain number).
    """
    def walk(value, path: tuple[str, ...]):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, (*path, k))
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            yield path[0], ".".join(path[1:]) or None, float(value)

    def parse(batches):
        for pdf in batches:
            rows = [(p, *x) for p, c in zip(pdf["shard"], pdf["value"]) for x in walk(json.loads(c), ())]
            yield pd.DataFrame(rows, columns=["shard", "metric", "key", "value"])

    ship(spark)
    root = base.rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").text(root, wholetext=True)
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("shard"), "value")
    own = re.sub(r"^file:/+", "/", root).rstrip("/")
    return files.where(F.regexp_replace("shard", "^file:/+", "/") != own).mapInPandas(parse, "shard string, metric string, key string, value double")


def matrix_runs(spark: SparkSession, base: str, protocol: str | None = None) -> DataFrame:
    """``scale, recipe, benchmark, summary`` of a grid of ``scale/recipe/benchmark/summary.json``; another protocol is an error."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").text(base, wholetext=True)
    part = F.split(F.col("_metadata.file_path"), "/")
    at = lambda k: F.element_at(part, -k)
    runs = files.select(at(4).alias("scale"), at(3).alias("recipe"), at(2).alias("benchmark"), F.col("value").alias("summary"))
    if protocol is None:
        return runs
    ok = F.coalesce(F.get_json_object("summary", "$.protocol") == protocol, F.lit(False))
    return runs.withColumn("summary", F.when(ok, F.col("summary")).otherwise(F.raise_error(F.concat(F.lit("unexpected protocol in "), F.concat_ws("/", "scale", "recipe", "benchmark")))))


def dotted(value: Column, path: str) -> Column:
    """A number in a JSON column by its dotted path; ``a//b`` is a ratio, null where ``b`` is 0 or missing."""
    if "//" in path:
        num, den = path.split("//")
        return F.try_divide(dotted(value, num), dotted(value, den))
    return F.get_json_object(value, f"$.{path}").try_cast("double")


def head_sample(df: DataFrame, n: int | None, order: str = "doc_id") -> DataFrame:
    return df if n is None or n <= 0 else df.orderBy(order).limit(n)


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``n`` rows by the order of ``sha256("seed:key")``: uniform, and the same each time."""
    if n <= 0:
        raise ValueError("n must be positive")
    rank = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 16)
    return df.withColumn("__r", rank).orderBy("__r", key).limit(n).drop("__r").orderBy(key)


def reservoir_sample(df: DataFrame, n: int | None, seed: int = 42, key: str = "doc_id") -> DataFrame:
    return df if n is None or n <= 0 else hash_sample(df, n, seed, key)


def token_blocks(spark: SparkSession, path: str, sequence_length: int, wide: bool | None = None, seed: int | None = None) -> DataFrame:
    """(path, block, tokens) of little-endian token files (u32 by suffix, else u16); a last part of a block is left out.

    With ``seed`` also ``position``: the block's place in the epoch, a permutation drawn
    from the seed by file.  An index beyond the epoch stands for itself modulo its length
    (``cyclic``).
    """
    if sequence_length <= 1:
        raise ValueError("sequence_length must be greater than one")

    def cut(batches):
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                kind = np.dtype("<u4" if (p.lower().endswith((".u32", ".uint32")) if wide is None else wide) else "<u2")
                if len(raw) % kind.itemsize:
                    raise ValueError(f"{p} isn't aligned to {kind.itemsize} bytes")
                n = len(raw) // kind.itemsize // sequence_length
                order = np.argsort(np.random.default_rng(seed).permutation(n)) if seed is not None else np.arange(n)
                every = np.frombuffer(raw, kind, n * sequence_length).astype(np.int64)
                step = max(1, (1 << 18) // sequence_length)
                for k in range(0, n, step):
                    m = min(step, n - k)
                    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, m * sequence_length + 1, sequence_length, dtype=np.int32)), pa.array(every[k * sequence_length : (k + m) * sequence_length]))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * m), pa.array(np.arange(k, k + m)), pa.array(order[k : k + m]), tokens], ["path", "block", "position", "tokens"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(cut, "path string, block long, position long, tokens array<long>")
    return out if seed is not None else out.drop("position")


def cyclic(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """``index, tokens`` of ``count`` blocks of one file from ``start`` on, round and round the epoch (``token_blocks`` with a seed)."""
    n = blocks.agg(F.count("*")).first()[0]
    want = blocks.sparkSession.range(start, start + count).select(F.col("id").alias("index"), F.pmod("id", F.lit(n)).alias("position"))
    return want.join(blocks, "position").select("index", "tokens")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def shuffled_choices(choices: list[str], gold: int, example_id: str, seed: int = 111) -> tuple[list[str], int]:
    """Choices in an order that depends on the seed and the example alone, and where the right one went."""
    order = list(range(len(choices)))
    random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{example_id}".encode()).digest()[:8], "big")).shuffle(order)
    return [choices[k].strip() for k in order], order.index(gold)


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])

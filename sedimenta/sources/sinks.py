"""Versioned results: per-document JSON lines, summaries, hash indexes."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import os
import platform
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

SCHEMA_VERSION = "1.0.0"


def contract(df: DataFrame, flags: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """(schema_version, artifact_type, doc_id, scores, flags): flags are booleans, scores the other columns."""
    kinds = dict(df.dtypes)
    wrong = [f for f in flags if kinds.get(f) != "boolean"]
    if wrong:
        raise ValueError(f"flags must be booleans: {wrong}")
    scores = [c for c in df.columns if c not in (*flags, id_col)]

    def finite(c: str) -> Column:
        if kinds[c] not in ("double", "float"):
            return F.col(c)
        bad = F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
        return F.when(bad, F.raise_error(F.lit(f"{c} must be finite")).cast("double")).otherwise(F.col(c))

    return df.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("per_doc").alias("artifact_type"), F.col(id_col).cast("string").alias("doc_id"), F.struct(*(finite(c).alias(c) for c in scores)).alias("scores"), F.struct(*flags).alias("flags"))


def write_per_doc(df: DataFrame, path: str, flags: tuple[str, ...]) -> None:
    contract(df, flags).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def summary_json(summary: DataFrame) -> str:
    """A one-row summary as JSON with its header; values must be finite."""
    row = summary.first().asDict(recursive=True)
    for k, v in row.items():
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"{k} must be finite")
    return json.dumps({"schema_version": SCHEMA_VERSION, "artifact_type": "summary", **row}, indent=2, ensure_ascii=False, default=str)


def put(spark, path: str, text: str) -> None:
    """Writes a small file through the file system that its path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_summary(summary: DataFrame, folder: str) -> None:
    """``summary.json`` in ``folder``, of a one-row summary."""
    put(summary.sparkSession, f"{folder.rstrip('/')}/summary.json", summary_json(summary))


def output_dir(base: str, dataset: str, stage: str, at: datetime.datetime | None = None) -> str:
    return f"{base.rstrip('/')}/{dataset}_{(at or datetime.datetime.now()).strftime('%Y%m%d_%H%M%S')}/{stage}"


def write_index(index: DataFrame, path: str, **parameters) -> None:
    """An index with the parameters it was built with, for readers to compare."""
    index.write.parquet(f"{path}/index")
    df = index.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in sorted(parameters.items())], "name string, value string")
    df.coalesce(1).write.parquet(f"{path}/parameters")


def read_index(spark, path: str, **parameters) -> DataFrame:
    have = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/parameters").collect()}  # a few settings
    wrong = {k: (v, have.get(k)) for k, v in parameters.items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"the index was built with other parameters: {wrong}")
    return spark.read.parquet(f"{path}/index")


#: The tables of a prebuilt benchmark index.
INDEX_TABLES = ("hash", "sig", "emb")


def write_bench_index(path: str, hashes: DataFrame | None = None, signatures: DataFrame | None = None, embeddings: DataFrame | None = None, **parameters) -> None:
    """The layers of a benchmark index that are given, each a table below ``path``, with the parameters they share."""
    for name, df in zip(INDEX_TABLES, (hashes, signatures, embeddings)):
        if df is not None:
            write_index(df, f"{path.rstrip('/')}/{name}", **parameters)


def read_bench_index(spark, path: str, layers: tuple[str, ...] = INDEX_TABLES, **parameters) -> dict[str, DataFrame]:
    """The layers by name, for ``exact(index=...)``, ``near(index=...)`` and ``embed``; other parameters are an error."""
    return {name: read_index(spark, f"{path.rstrip('/')}/{name}", **parameters) for name in layers}


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines in ASCII, keys in order."""
    plain = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(_ascii(plain).alias("value")).write.text(path)


@F.pandas_udf(types.StringType())
def _ascii(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else json.dumps(json.loads(v), ensure_ascii=True, sort_keys=True, separators=(",", ":")))


def write_shard(df: DataFrame, done: str, shard: str) -> bool:
    """Writes a shard's rows below ``done`` unless an earlier run finished it; whether it wrote."""
    jvm = df.sparkSession.sparkContext._jvm
    path = f"{done.rstrip('/')}/shard={shard}"
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def remaining(docs: DataFrame, done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that an earlier run has no result for."""
    return docs.join(done.select(id_col).distinct(), id_col, "left_anti")


class RunRecorder:
    """What a run leaves on the driver's side: manifest, status, events, checksums of checkpoints.

    Files are replaced as a whole; an event is one append, so a killed run leaves no half
    line.  A second recorder of the same folder takes over the run it finds there.
    """

    def __init__(self, folder: str, name: str, command: str = "", config: dict | None = None):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        manifest = self.folder / "run_manifest.json"
        own = {"schema_version": SCHEMA_VERSION, "run_id": uuid.uuid4().hex, "run_name": name, "created_at": self._now(), "command": command, "config": config or {}, "environment": {"python": platform.python_version(), "machine": platform.machine()}}
        try:
            with open(manifest, "x", encoding="utf-8") as f:  # one of several starters makes it
                json.dump(own, f, indent=2)
        except FileExistsError:
            own = json.loads(manifest.read_text(encoding="utf-8"))
        self.run_id = own["run_id"]
        if not (self.folder / "status.json").exists():
            self.status("running")

    @staticmethod
    def _now() -> str:
        return datetime.datetime.now(datetime.UTC).isoformat()

    def _replace(self, name: str, value: dict) -> dict:
        part = self.folder / f".{name}.{uuid.uuid4().hex}"
        part.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
        os.replace(part, self.folder / name)
        return value

    def status(self, state: str, **fields) -> dict:
        at = self.folder / "status.json"
        try:
            before = json.loads(at.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            before = {}
        return self._replace("status.json", {**before, "schema_version": SCHEMA_VERSION, "run_id": self.run_id, "state": state, "updated_at": self._now(), **fields})

    def event(self, name: str, **fields) -> dict:
        record = {"schema_version": SCHEMA_VERSION, "run_id": self.run_id, "timestamp": self._now(), "event": name, **fields}
        fd = os.open(self.folder / "events.jsonl", os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            os.write(fd, (json.dumps(record, ensure_ascii=False) + "\n").encode())
            os.fsync(fd)
        finally:
            os.close(fd)
        return record

    def summary(self, value: dict) -> dict:
        return self._replace("summary.json", value)

    def checkpoint(self, path: str, step: int, **extra) -> dict:
        """Names, sizes and hashes of a checkpoint's files."""
        root = Path(path)
        if not root.exists():
            raise FileNotFoundError(path)
        files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file())

        def digest(p: Path) -> str:
            with p.open("rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()

        rows = [{"path": p.name if p == root else str(p.relative_to(root)), "size": p.stat().st_size, "sha256": digest(p)} for p in files]
        return self._replace(f"checkpoint_{step}.json", {"schema_version": SCHEMA_VERSION, "run_id": self.run_id, "step": step, "checkpoint": str(root), "files": rows, **extra})

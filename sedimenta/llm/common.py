"""Session-level helpers of this subpackage: shared folder, sizing, packed exchange."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Source bytes that one shard of a packed exchange stands for.
SHARD_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is unset, as in tests on one machine, a folder of this
    machine is made and set; on a cluster that is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + (made := tempfile.mkdtemp(prefix="sedimenta-"))
        atexit.register(shutil.rmtree, made, True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a path, through the file system that it names."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the gateway may be gone at exit
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which ``small`` broadcasts; beyond, the join is left to Catalyst.
SMALL_BYTES = 64 << 20


def fits(df: DataFrame, most: int = SMALL_BYTES) -> bool:
    """Whether the values of ``df`` (written before) take at most ``most`` bytes."""
    fixed = 16 + sum({"string": 8, "binary": 8}.get(k, 16 if k.startswith("decimal") else 8) for _, k in df.dtypes)
    grows = [F.octet_length(c) if k in ("string", "binary") else F.size(c) * 16 for c, k in df.dtypes if k in ("string", "binary") or k.startswith(("array", "map"))]
    each = sum((F.coalesce(g, F.lit(0)) for g in grows), F.lit(fixed)).cast("long")
    return df.limit(most // fixed + 1).agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] <= most


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` (written before) to be broadcast if its values take at most ``most`` bytes; else as it is."""
    return F.broadcast(df) if fits(df, most) else df


def source_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of what ``df`` scans; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


def shards_for(df: DataFrame, each: int = SHARD_BYTES) -> int:
    """Number of shards for an exchange over ``df``: follows its size, 4 at least; a shard's name has 24 bits."""
    ship(df.sparkSession)
    return int(min(max(4, -(-source_bytes(df) // each)), 1 << 24))


def by_name(shard: np.ndarray, shards: int) -> np.ndarray:
    """Stable order by shard."""
    return np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")


def give_back() -> None:
    """Returns freed memory to the machine: workers live as long as their executor."""
    try:
        import ctypes

        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to return
        pass


def by_shard(df: DataFrame, fn: Callable, schema: str, key: str | list[str] = "shard") -> DataFrame:
    """``fn(table) -> table`` on all rows of each shard."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            give_back()

    return df.groupBy(key).applyInArrow(run, schema)


def streamed(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(batches) -> batches`` on the rows of each task."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with a prefix that no column of ``df`` has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def is_whole(df: DataFrame, col: str) -> bool:
    return dict(df.select(col).dtypes)[col] in ("tinyint", "smallint", "int", "bigint")


def key_of(df: DataFrame, id_col: str) -> Column:
    """A row's id as a long: itself if ids are whole numbers, else a hash of its text (64 bits; ``named`` undoes it)."""
    return F.col(id_col).cast("long") if is_whole(df, id_col) else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))


def named(found: DataFrame, docs: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``found`` with the ids of ``docs`` in place of ``key_of`` in ``columns``; order among ids is that of the hashes."""
    if is_whole(docs, id_col):
        return found
    names = docs.select(key_of(docs, id_col).alias("__key"), F.col(id_col).alias("__name")).where("__key IS NOT NULL").distinct()
    order = found.columns
    for c in columns:
        found = found.join(names, F.col(c) == F.col("__key"), "left").drop("__key", c).withColumnRenamed("__name", c)
    return found.select(order)


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of rows that have an id; whatever other columns there are stays behind."""
    ship(docs.sparkSession)
    return docs.select(key_of(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: a header of (type, count), then their bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], dtype="<i8")
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(value: bytes) -> list[np.ndarray]:
    """The arrays that ``pack`` took; views of ``value`` where alignment allows."""
    n = int(np.frombuffer(value, "<i8", 1)[0])
    head = np.frombuffer(value, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, count in head:
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(value, kind, int(count), at))
        at += int(count) * kind.itemsize
    return out


def low(h: np.ndarray, n: int) -> np.ndarray:
    """The low ``n`` bytes of 64-bit values, one after the other."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :n].ravel()


def whole(b: np.ndarray, n: int) -> np.ndarray:
    """64-bit values from their low ``n`` bytes."""
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = b.reshape(-1, n)
    return out.view(np.uint64).ravel()


def encode(gaps: np.ndarray, wide: bool = False) -> np.ndarray:
    """Gaps as bytes (or 16-bit words); the largest value means: add it and read on."""
    kind = np.uint16 if wide else np.uint8
    top = np.iinfo(kind).max
    ends = np.cumsum(gaps // top + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, top, kind)
    out[ends - 1] = gaps % top
    return out


def decode(codes: np.ndarray) -> np.ndarray:
    top = np.iinfo(codes.dtype).max
    sums = np.cumsum(codes.astype(np.int64))[codes != top]
    return np.diff(sums, prepend=0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``starts[i] .. starts[i] + counts[i] - 1``."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts.astype(np.int64), counts)

"""Audits as streams: an extension, for inputs that keep arriving.

The batch operators fold over finite tables; these give the same folds over a stream
of documents, with bounded state.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions.session import gathered, shared_dir
from ..ship import ship
from ..sources.sinks import write_shard


def windowed_stats(docs: DataFrame, at: str = "ts", window: str = "1 day", late: str = "1 hour", key: str = "source") -> DataFrame:
    """Documents, characters and tokens by window and key; what is later than the watermark is dropped."""
    d = docs.withWatermark(at, late)
    return d.groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.words(F.col("text")))).alias("tokens")).select(F.col("w.start").alias("start"), key, "docs", "chars", "tokens")


def first_copies(docs: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Documents whose text wasn't seen within the watermark."""
    return docs.withColumn("doc_hash", F.md5("text")).withWatermark(at, late).dropDuplicatesWithinWatermark(["doc_hash"])


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events by user and session of less than ``gap`` between neighbours."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_shingles(docs: DataFrame, n: int = 13, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """``doc_id, shingle`` of word n-grams that weren't seen within the watermark: each document's share of what is new."""
    s = docs.select("doc_id", at, F.explode(F.array_distinct(T.shingles(T.words(F.col("text")), n))).alias("s")).where("s <> ''")
    return s.select("doc_id", at, F.xxhash64("s").alias("shingle")).withWatermark(at, late).dropDuplicatesWithinWatermark(["shingle"])


#: Parts by which shingles are kept: a part of a batch is held in memory at a time.
SHARDS = 512


def _packed_shingles(n: int):
    """Texts to (shard, hashes of distinct shingles as bytes); a shard is a range of hashes."""
    cuts = (np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(64 - (SHARDS - 1).bit_length())).astype(np.uint64)

    def run(batches):
        for batch in batches:
            data, offsets = A.raw(batch.column("t"))
            found = [A.distinct(A.word_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)) for lo, hi in A.parts(offsets)]
            h = A.distinct(np.concatenate([np.zeros(0, np.uint64), *found]))
            parts = [(i, x.tobytes()) for i, x in enumerate(np.split(h, np.searchsorted(h, cuts))) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["shard", "hashes"])

    return run


def _united(table: pa.Table) -> np.ndarray:
    return A.distinct(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]))


def shingle_runs(n: int = 13, text: str = "text"):
    """(fold, result): the distinct word n-grams of all of a stream, by 64-bit hashes.

    ``first_shingles`` keeps what was seen within the watermark in the executors'
    memory; without lateness to forget by, that is all shingles.  Here ``fold(batch,
    batch_id)``, for ``foreachBatch``, leaves a batch's distinct ones in the shared
    folder, packed by shards, and ``result(spark)`` unites them shard by shard:
    ``shingle``.  A batch that is repeated replaces its first run.
    """
    runs: dict[int, str] = {}

    def fold(batch: DataFrame, batch_id: int) -> None:
        ship(batch.sparkSession)
        path = f"{shared_dir(batch.sparkSession).rstrip('/')}/shingles-{uuid.uuid4().hex}"
        one = lambda t: pa.table({"shard": t.column("shard")[:1], "hashes": pa.array([_united(t).tobytes()], pa.binary())})
        packs = batch.select(F.col(text).cast("string").alias("t")).mapInArrow(_packed_shingles(n), "shard int, hashes binary")
        gathered(packs, "shard", SHARDS, batch.rdd.getNumPartitions()).groupBy("shard").applyInArrow(one, "shard int, hashes binary").write.parquet(path)
        runs[batch_id] = path

    def result(spark) -> DataFrame:
        held = spark.read.schema("shard int, hashes binary").parquet(*runs.values()) if runs else spark.createDataFrame([], "shard int, hashes binary")
        return gathered(held, "shard", SHARDS, held.rdd.getNumPartitions()).groupBy("shard").applyInArrow(lambda t: pa.table({"shingle": _united(t).view(np.int64)}), "shingle long")

    return fold, result


def hash_reservoir(n: int, seed: int = 42, key: str = "doc_id"):
    """(fold, result): a uniform sample of ``n`` of a stream, by the order of a hash.

    ``fold(batch, batch_id)`` is for ``foreachBatch``: it merges a batch's ``n`` best with
    those held so far, in the shared folder; ``result(spark)`` reads them.  Merging is
    the same in any order, so shards can be folded apart and their samples merged.
    """
    state: dict[str, str] = {}

    def best(df: DataFrame) -> DataFrame:
        rank = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 16)
        return df.withColumn("__r", rank).orderBy("__r", key).limit(n).drop("__r")

    def fold(batch: DataFrame, batch_id: int) -> None:
        held = batch.sparkSession.read.parquet(state["at"]) if "at" in state else None
        both = batch if held is None else held.unionByName(batch).dropDuplicates([key])
        path = f"{shared_dir(batch.sparkSession).rstrip('/')}/reservoir-{uuid.uuid4().hex}"
        best(both).write.parquet(path)
        state["at"] = path

    def result(spark) -> DataFrame:
        return spark.read.parquet(state["at"])

    return fold, result


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its input is used up, as a table of the shared folder."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def last(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def shards(docs: DataFrame, done: str, operator) -> None:
    """Works off a stream of documents batch by batch, each a shard that is written once: a restart goes on behind the last."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write_shard(operator(batch), done, f"{batch_id:06d}")

    docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{done.rstrip('/')}/_state").trigger(availableNow=True).start().awaitTermination()

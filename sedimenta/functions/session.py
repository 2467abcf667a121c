"""What operators take from the session: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which ``small`` broadcasts; beyond, the join is left to Catalyst.
SMALL_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, and only on one machine, a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + (made := tempfile.mkdtemp(prefix="sedimenta-"))
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(where)
    return where


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
    """``df`` written to the shared folder and read again: lineage ends there.  Removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` to be broadcast if its values take at most ``most`` bytes; else as it is."""
    fixed = 16 + 8 * len(df.columns)
    grows = [F.octet_length(c) if k in ("string", "binary") else F.size(c) * 16 for c, k in df.dtypes if k in ("string", "binary") or k.startswith(("array", "map"))]
    each = sum((F.coalesce(g, F.lit(0)) for g in grows), F.lit(fixed)).cast("long")
    found = df.limit(most // fixed + 1).agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return F.broadcast(df) if found <= most else df


def gathered(df: DataFrame, key: str, most: int, splits: int) -> DataFrame:
    """``df`` with the rows of each of ``most`` keys together, in tasks that grow in number with the input's ``splits``, not in size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, max(least, 4 * splits)), key)

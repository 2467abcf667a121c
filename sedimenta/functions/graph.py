"""Connected components and pointer jumping on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges(u, v)`` that aren't roots: alternating large and small stars."""
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now, seen = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        least = both(now).groupBy("u").agg(F.min("v").alias("m"))
        large = both(now).join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        linked = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        now = written(new.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest ``parents(node, parent)``; roots have a null parent.  Distances double each round."""
    now = written(parents.select("node", F.coalesce("parent", "node").alias("root")), "parents")
    while True:
        up = now.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = written(now.join(up, F.col("root") == F.col("n2")).select("node", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved")), "parents")
        if not new.where("moved").limit(1).count():
            return new.select("node", "root")
        now = new.select("node", "root")

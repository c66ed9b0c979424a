"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, materialize, source_path


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` with comp the smallest node reachable; ``edges`` has
    long columns ``a``, ``b`` (null ends and loops are ignored). Alternates
    large-star and small-star steps (each node points at the smallest node it
    knows), which needs O(log n) rounds on chains too; every round is written
    to the shared checkpoint folder. Minima are partially aggregated, so a
    node with a third of all edges gathers nothing; the join back splits."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        drop_path(e.sparkSession, source_path(large))
        drop_path(e.sparkSession, source_path(e))
        e = nxt
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )

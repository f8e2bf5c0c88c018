"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is gathered in one task; a hub's edges only meet in
joins, whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, shared_path


def _lowest(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): (u, m), m the smallest of u and its v."""
    return pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs, any direction: (node, root) for every node but the roots, the smallest of each component."""
    spark = edges.sparkSession
    state, path, mark = edges.where("u <> v").select("u", "v"), None, None
    for _ in range(rounds):
        new = shared_path(spark, "components")
        _small_star(_large_star(state)).write.parquet(new)
        state = spark.read.schema("u long, v long").parquet(new)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if path:
            delete_path(spark, path)
        path = new
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation with a map-side part and a join on the node, which adaptive
execution can split where a node has many edges. Nothing is collected; each round is a table
in the shared folder, and the one before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored, stored_since


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b of one ordered type. Returns node, root for all nodes with an edge but the roots.

    Edges from a node to itself and those with a null count for nothing; repeated ones count once;
    no edge gives no row; other columns are ignored. The rounds grow with the logarithm of a
    component's size; a graph that isn't done after `rounds` of them is an error.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        last = stored_since()[-1]
        now = stored(_small_star(_large_star(now)), "edges")
        forget(spark, [last])
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"no fixed point after {rounds} rounds")

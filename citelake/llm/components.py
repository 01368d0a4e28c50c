"""Connected components of an edge table, by alternating large-star and small-star steps.

Nodes are of any type that can be ordered; a component is named by its smallest node.  Every step is an aggregation and a join whose
output is no larger than the edge table, so neither a hub with very many neighbours nor a long chain gathers
anywhere; the number of steps grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.scratch import Scratch


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges u, v with the m of their u.  The hash in the join key makes Spark deal both sides for the join itself,
    so that it can split the rows of a hub."""
    least = least.withColumn("hw", F.xxhash64("w"))
    return edges.join(least, (F.xxhash64("u") == F.col("hw")) & (F.col("u") == F.col("w")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = _with_least(both.where("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = _with_least(down, least.withColumnRenamed("u", "w")).where("v <> m")
    return least.select(F.col("u").alias("a"), F.col("m").alias("b")).union(kept.select("v", "m")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns a, b) but the components' smallest nodes.

    Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    step = 0
    while True:
        # A forest of stars: no node points to two others, and no node that is pointed to points on.
        heads = now.select(F.col("b").alias("h")).distinct()
        unruly = now.join(heads, F.col("a") == F.col("h"), "left_semi").select("a").union(
            now.groupBy("a").count().where("count > 1").select("a")
        )
        if not unruly.take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        step += 1
        after = scratch.keep(_small_star(_large_star(now)), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after

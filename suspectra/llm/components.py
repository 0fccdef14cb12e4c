"""Connected components by alternating large-star and small-star steps.

Each step keeps connectivity and moves edges towards the smallest member; steps
end when all components are stars. Everything stays in tables; a hub's edges are dealt
over several tasks when they meet its smallest neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. Each node's neighbours (the larger ones; or the smaller ones and itself) go to its smallest neighbour."""
    both = edges.union(edges.select("b", "a")) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        moved = spread_join(both.filter(F.col("b") > F.col("a")), low.withColumn("m", F.least("m", "a")), ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = spread_join(both, low, ["a"], "b").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
    moved = moved.filter(F.col("a") != F.col("b"))
    return moved if large else moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't its component's smallest. Each step moves an edge to a smaller node, so it ends."""
    state = stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    while not _settled(state):
        state = stage_table(_star(_star(state, True), False), "star")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: each node has one root, and no root has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() == 0

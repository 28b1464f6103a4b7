"""Connected components of an edge table by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written


def _towards_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b): neighbours are linked to the least vertex of the neighbourhood.

    The large step moves the neighbours above a vertex, the small step those below it and the vertex itself.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, component (the least vertex reachable) of every vertex that has an edge (a, b) to another one."""
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(turned.where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == tuple(seen):
            break
        before = tuple(seen)
        current = written(_towards_least(_towards_least(current, large=True), large=False), "edges")
    leaves = current.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return leaves.unionByName(current.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())

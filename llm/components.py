"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from its smaller end ``a`` to its larger end ``b``."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, label`` for every end of an edge ``a < b`` that is not the smallest of its component.

    The label is the smallest node.  Each round is stored in ``folder``; the number of rounds grows
    with the logarithm of the longest path.  Minima are combined before the shuffle, so a node
    with many edges is no more than a skewed join, which adaptive execution splits.
    """
    current, state, number = stored(edges.select("a", "b").distinct(), folder, f"{name}-0"), None, 0
    while True:
        summary = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(summary) == state or not summary[0]:
            return current.select(F.col("b").alias("node"), F.col("a").alias("label"))
        state, number = tuple(summary), number + 1
        current = stored(_small_star(_large_star(current)).distinct(), folder, f"{name}-{number}")

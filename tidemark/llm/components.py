"""Connected components by alternating large and small stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); the component is its least node.

    It ends when a step changes no edge; the number of steps grows with the logarithm of the longest path.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    for _ in range(most):
        now = written(_small(_large(now)), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is a grouped minimum (combined before the shuffle) and a join, so a node with
very many links is never gathered, and nothing reaches the driver but one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm import tables


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Does every node have either one edge down or none but edges up to it?

    As the steps keep what is connected, all components then hang on their smallest node.
    """
    down = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = down.union(up).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.where("down + up > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is its smallest node.

    Repeated and reversed edges count once, edges of a node to itself not at all, and an
    empty table gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = tables.stage(edges, "edges")
    while not _are_stars(edges):
        edges = tables.stage(_small_star(_large_star(edges)), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _pairs(edges: DataFrame) -> DataFrame:
    """Edges as (hi, lo) with hi > lo, once each."""
    return edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi != lo").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = staged(least.select("node", F.least("node", "least").alias("least")), "least")
    larger = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    return larger.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the least of them."""
    least = staged(edges.groupBy("hi").agg(F.min("lo").alias("least")), "least")
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each upper node has one edge and is below no other."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node reachable.

    ``edges`` has the columns hi and lo of one ordered type. What each half round finds is written to the
    shared folder: plans stay short, lost executors cost tasks only, and the joins that follow read both
    sides through a shuffle, where Spark splits a hub with many edges. The rounds end when each component
    is a star around its least node.
    """
    edges = staged(_pairs(edges), "edges")
    while not _all_stars(edges):
        edges = staged(_pairs(_large_star(edges)), "edges")
        edges = staged(_pairs(_small_star(edges)), "edges")
    roots = edges.select(F.col("lo").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)

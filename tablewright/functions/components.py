"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    lows = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates the two star operations of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014); the number of rounds grows with the logarithm of the size.  Every round is
    written to the shared folder, which cuts the lineage.
    """
    larger, smaller = F.greatest(a, b), F.least(a, b)
    current = stage(edges.select(larger.alias("u"), smaller.alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        current = stage(_small_star(_large_star(current)), "edges")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _split_join(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """Edges with the row of their node. The second key makes both sides get an exchange for this join alone, so adaptive
    execution can split the edges of a node that has very many."""
    part = F.pmod(F.col(key), F.lit(2))
    return edges.withColumn("_k", part).join(least.withColumn("_k", part), [key, "_k"]).drop("_k")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for edges (a, b) of longs.

    Each round joins every node's neighbours to the least of them and keeps distinct edges; a node that is the least of a
    big component gathers only in aggregates. Rounds are written to the shared folder, and only the number of edges and
    their sum, by which a round without change shows, reach the driver. A round that changes something moves edges to smaller nodes,
    so the loop ends; rounds grow with the square of the logarithm of the longest path at most.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        # Large star: larger neighbours of a node go to its least neighbour (itself counts).
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _split_join(both.where("v > u"), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: a node and its smaller neighbours go to the least of them.
        small = large.where("a < b").distinct()
        low = small.groupBy("b").agg(F.min("a").alias("m"))
        moved = _split_join(small, low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        links = written(moved.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = links.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return stars.unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct().join(stars.select("node"), "node", "left_anti"))



"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.plans.session import cut_lineage


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest one around it; edges run downward."""
    upward = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionByName(upward).groupBy("a").agg(
        F.least(F.min("b"), F.col("a")).alias("least"))
    return upward.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties the smaller neighbours of a node, and itself, to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(
        least.select("a", F.col("least").alias("b")))


def _only_stars(edges: DataFrame) -> bool:
    """Every node hangs under one node which hangs under none."""
    hangs, holds = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.col("a").alias("node"), hangs.alias("hangs"), holds.alias("holds")).union(
        edges.select(F.col("b").alias("node"), holds.alias("hangs"), hangs.alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where(
        "hangs + holds > 1 AND hangs > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) but the roots: the smallest node it reaches.

    The number of rounds grows with the logarithm of the longest path; no group
    of edges is gathered, so a node with very many neighbours is only a join key.
    Self loops and repeated edges are ignored; an edge with a null end is dropped.
    """
    edges = cut_lineage(_downward(edges.where("a IS NOT NULL AND b IS NOT NULL")))
    while not _only_stars(edges):
        # the large star makes one row of each edge, already downward; repeats go at the end of the round
        edges = cut_lineage(_downward(_small_star(_large_star(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

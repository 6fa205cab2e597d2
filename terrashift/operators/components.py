"""Connected components by alternating large-star and small-star steps, each a join and a minimum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Edges never grow in number; ``keep`` stores each round and cuts its lineage, and only whether all
    are stars comes to the driver. Rounds end when they are. Hubs are reduced by partial minima and
    their joins are ordinary equi-joins that adaptive execution splits.
    """
    current = keep(_ordered(edges))
    while not _all_stars(current):
        current = keep(_small_star(_large_star(current)))
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return leaves.union(roots).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones: then that is the component."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    between = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return several.union(between).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()

"""Connected components of a graph given as edges, by alternating stars.

A large-star step points every greater neighbour of a node to the least
node near it, a small-star step does so for the lesser ones. Both keep the
components and end, after a few rounds, with an edge from each node to its
component's least node. A node with very many edges only meets a minimum
(combined before the shuffle) and a join whose skew Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` with another neighbour.

    ``component`` is the least node that can be reached. Each round is
    written to the shared folder, which also cuts the lineage.
    """
    current = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        current = stored(_small_star(_large_star(current)), "edges")

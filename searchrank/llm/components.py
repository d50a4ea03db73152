"""Connected components of an undirected edge table, by alternating large and small stars.

Every step is joins and aggregations on the edge table: each vertex's smallest neighbour is a
combined ``min``, and edges are rewritten towards it.  No vertex's neighbour list is ever gathered,
so a vertex with very many links is many small rows.  The edges are checkpointed after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, comp)`` for every vertex of ``edges(a, b)``; ``comp`` is the smallest vertex reachable."""
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        edges = cut_lineage(_small_star(_large_star(edges)))
    # every vertex now points at its component's smallest vertex
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())

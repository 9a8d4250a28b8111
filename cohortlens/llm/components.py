"""Connected components of a link table by alternating star steps.

Every step is a group-by and a join on edges; edges are written in the shared folder after each round. Nothing is
collected but a count and a checksum. A node with very many links is a hot key of a minimum (combined map-side) and of
joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (``a, b``) that is not itself the
    smallest of its component."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "component-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now

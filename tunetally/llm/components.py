"""Connected components of a table of links, as joins and aggregates.

Links are turned into stars by alternating two steps until all are stars: every node
tells its larger neighbours the smallest node it knows, then every node ties its smaller
neighbours to the smallest of them. All tables stay distributed and every step is written,
so a lost executor costs a reread only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetally.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Every neighbour of a node is tied to the node's smallest neighbour or itself."""
    near = edges if smaller_only else _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if smaller_only:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        tied = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """`links` (a, b) to (node, component): every node that has a link to another node, and
    the smallest node it reaches. Nodes without links are not listed; nulls are no nodes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = edges.where((F.col("u") != F.col("v")) & links["a"].isNotNull() & links["b"].isNotNull())
    edges = materialize(edges.distinct(), label)
    while not _done(edges):
        edges = materialize(_stars(materialize(_stars(edges, False), label), True), label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _done(edges: DataFrame) -> bool:
    """Whether all are stars: no node has two smaller neighbours, or one and a larger one."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"))
    sides = sides.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("low")))
    mixed = sides.groupBy("node").agg(F.sum("low").alias("lows"), F.min("low").alias("least"))
    return mixed.where("lows > 1 or (lows = 1 and least = 0)").isEmpty()

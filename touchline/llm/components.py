"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, save: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node reachable.

    Stars only ever need the smallest neighbour, a partial aggregate, so a hub
    with a third of all links is never gathered. Rounds grow with the logarithm
    of the longest chain and end when only stars are left. Links with a null end
    are left out; no links, no rows.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = save(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _only_stars(edges):
        edges = save(_star(_star(edges, True), False))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is no edge's v. Counts per node, summed inside tasks first."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    down = edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return not nodes.agg(F.max(F.col("ups") + F.col("downs") * F.least("ups", F.lit(1))).alias("most")).where("most > 1").head(1)

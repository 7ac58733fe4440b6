"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins over the links; the links become
stars around the smallest node of their component after a number of rounds that
grows with the logarithm of the component's size. Nothing reaches the driver
but whether stars are all there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwarden.llm.common import lacks, saved


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """(u, v) with v < u in; each neighbour is handed to the smallest node that u sees."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    # written, so that the join below has a plain shuffle on either side and a hub's rows can be split
    least = saved(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    handed = sides.where("v > u" if both_ways else "v < u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both_ways:
        handed = handed.unionAll(least.select("u", F.col("m").alias("v")))
    return handed.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Every node but the hubs has one link, and that is to a hub."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))
    parts = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return lacks(parts.where("leaf + hub > 1"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has two columns of longs; links of a node with itself and repeated
    links are harmless.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = saved(edges.distinct(), "star-links")
    while not _are_stars(edges):
        edges = saved(_stars(saved(_stars(edges, True), "star-links"), False), "star-links")
    hubs = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        hubs.select("node", F.col("node").alias("component"))
    )

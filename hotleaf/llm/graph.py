"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.llm.shared import settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u that isn't the least of its component, v being the least.

    ``edges`` has columns u > v.  Each round is a few shuffles of the edge table and ends in the shared folder; the
    number of rounds grows with the logarithm of the components' size.  Nothing but a count and a checksum comes
    to the driver.
    """
    seen = None
    while True:
        edges = settled(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges
        seen = now

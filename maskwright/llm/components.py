"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _pull(edges: DataFrame, of: str, to: str) -> DataFrame:
    """Each edge (u, v) with the least of u's neighbours and u itself as ``low``."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return edges.join(low, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every linked node: the least node that links reach.

    Large stars and small stars in turn (each node hands its neighbours to its least one) until nothing
    changes. A node with very many links is a join key, whose rows Spark can split. Links of a node to
    itself, null ends and repeated links don't matter.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v AND v IS NOT NULL").distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")))
    last = None
    while (now := edges.agg(mark.alias("m")).first()["m"]) != last:
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pull(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "large-stars")
        small = _pull(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        edges = stored(small.filter("u > v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

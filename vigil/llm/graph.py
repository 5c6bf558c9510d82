"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v.  Only the least neighbour of a node is aggregated; no neighbour list is built."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link at most and no node that is pointed to has one: then no step changes anything."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where(F.col("out") + F.col("into") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, component), the component being the least node that can be reached.

    Nodes without a link are not returned; self links, repeats and links with a null count for nothing.  Each round is written to the shared folder, in place of the one before.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", few=True)
    while not _settled(now):
        before, now = now, save(_star(_star(now, True), False), "stars", few=True)
        erase(before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

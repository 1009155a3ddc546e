"""Connected components by alternating star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours move to the least node near u.  Small star: smaller ones do, and u itself.

    A node's least neighbour is aggregated before the shuffle and joined back,
    so a node of many edges is no group in one task.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Loops until the edge table no longer changes; each round is a written table.
    """
    def mark(t):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before, seen = None, mark(now)
    while seen != before:
        after = scratch.write(_toward_least(_toward_least(now, True), False), "edges")
        before, seen = seen, mark(after)
        scratch.drop(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select("root", "root").distinct())

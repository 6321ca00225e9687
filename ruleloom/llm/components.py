"""Connected components of a graph of any size, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def _stars(edges: DataFrame) -> DataFrame:
    """One round of alternating stars: every node is tied to the least node near it."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return near.select("e.u", "e.v").where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of its own to one that leads nowhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("tails"), F.lit(0).alias("heads")), F.struct(F.col("v").alias("node"), F.lit(0).alias("tails"), F.lit(1).alias("heads")))).alias("e"))
    at = ends.groupBy("e.node").agg(F.sum("e.tails").alias("tails"), F.max("e.heads").alias("heads"))
    return not at.agg(F.max((F.col("tails") > 1) | ((F.col("tails") > 0) & (F.col("heads") > 0)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(u, v)``; ``root`` is the least node of its component.

    Rounds end when one changes nothing; their number grows with the logarithm of
    the longest path.  Nulls aren't links; loops and repeats don't matter; no links
    give no rows.  Minima of a node with very many links are partial ones first; its
    edges stand in one partition of the join unless the minima are few enough to be
    broadcast.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "components")
    while not _settled(edges):
        before, edges = edges, written(_stars(edges), "components")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

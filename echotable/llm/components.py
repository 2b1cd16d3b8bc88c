"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, repeats allowed -> (node, component), the smallest node reachable; only linked nodes.

    Minima are taken by a partial aggregation and joined back, so that Spark can split the join where one node has very
    many links. It ends when all that is left are stars: every node has one link, to a node that has none further down.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min(F.least("u", "v")).alias("m"))
        large = stored(both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("x"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = stored(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two links downwards, or one to a node that has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()

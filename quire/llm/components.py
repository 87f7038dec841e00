"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def _lower_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Every larger node has one link, to a node that has none to a smaller one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that can be reached.

    Alternates two star steps until every component is a star: each node's larger neighbours are
    linked to its smallest neighbour, then its smaller neighbours are. Every step is an
    aggregate of minima and a join with it, so a node with many links gathers nothing.
    Links that are null on a side or lead to themselves are left out; an empty table gives
    an empty one.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = _lower_neighbour(both).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = _lower_neighbour(large)
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

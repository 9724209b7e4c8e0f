"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def _all_to_roots(links: DataFrame) -> bool:
    """Every node has one link up at most, and none if a link leads to it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return nodes.where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node with a link (a, b); component: its smallest node.

    Each round is written to the shared folder, which cuts the lineage.  A hub is
    never gathered: its smallest neighbour is a partial aggregate, and the join that
    hands it out is one that adaptive execution can split.  Links to oneself and
    nulls are left out; without links there are no rows.  Rounds end when all links lead
    to a root: a further round would change nothing, and is not run to find that out.
    """
    links = stage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while not _all_to_roots(links):
        links = stage(_small_star(_large_star(links)), "links")
        release(links.sparkSession)
    smallest = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return smallest.unionByName(roots)

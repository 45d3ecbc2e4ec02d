"""Connected components by alternating large-star and small-star, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.operators.hot_keys import join_counted
from patchweave.tables import drop_table, write_table


def _fold(pairs: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours, and their number; folded before the shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b) of any ordered type: node, root (the component's least node). Loops may stand for
    single nodes; the rounds grow with the logarithm of a component's size. The order of a node's edges never matters,
    and no node's edges are gathered: a round is two aggregates and two joins, in which a node with many edges is
    broadcast with its least neighbour, so its edges stay where they are."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = write_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: what is above a node is linked to the least that the node knows.
        large = join_counted(both.filter("b > a"), _fold(both), "a", "n", 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_table(large.distinct(), "edges")
        # Small star: a node and what is below it are linked to the least below it.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, "a", "n", size).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = write_table(small.filter("a <> b").distinct(), "edges")
        drop_table(large)
        before, size = size, after.count()
        same = size == before and not after.join(now, ["a", "b"], "left_anti").limit(1).count()
        drop_table(now)
        now = after
        if same:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

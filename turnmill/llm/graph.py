"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnmill.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node that has an edge. ``edges``: a, b (longs).

    Every round points each node at the smallest neighbour it knows: first every larger neighbour of a node is linked to
    the smallest one around it, then every node passes its smallest neighbour to the smaller ones. The edges shrink to
    stars around the roots in a number of rounds that grows with the logarithm of the longest path. Minima combine
    before the shuffle and each round is written, so a component may hold a large part of all nodes. A null end, or a
    node linked to itself, adds nothing.
    """
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = materialize(large.filter("a != b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(least, "a")
        links = materialize(moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))).filter("a != b").select(
                F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # The stars that are left have one edge per node and its root at the other end.
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

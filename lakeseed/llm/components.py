"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of those; b is the smaller end."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    rest = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable, for every node of the edges (a, b).

    Edges in either direction, repeated or from a node to itself are fine; null ends tie nothing. No
    node's edges are gathered: the least neighbour is an aggregate, joined back to the edges.
    """
    usable = stored(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    alone = usable.where("a = b").select(F.col("a").alias("node")).distinct()
    tied = usable.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tied, state = stored(tied, "edges"), None
    while True:
        now = tied.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        tied = stored(_small_star(_large_star(tied)), "edges")
    stars = tied.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = tied.select(F.col("b").alias("node")).union(alone).distinct().join(stars, "node", "left_anti")
    return stars.union(roots.select("node", F.col("node").alias("component")))

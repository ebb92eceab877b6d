"""What can be reached over directed edges, and in how few steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import bucketed, stored


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, steps: every node that can be reached from the seeds (``node``), and the fewest steps it takes.

    ``edges`` has ``a`` and ``b``. Each round follows the edges of the nodes found in the last one only, and keeps what
    no earlier round has found, so every edge is followed once and cycles end. Edges are
    written in buckets by their start, so no round exchanges them. Null nodes are neither seeds nor reached.
    """
    known = edges.select("a", "b").where("a is not null and b is not null").distinct()
    known = bucketed(known, "a", "edges")
    found = [stored(seeds.select("node").where("node is not null").distinct().withColumn("steps", F.lit(0).cast("long")), "reached")]
    while not found[-1].isEmpty():
        ends = found[-1].join(known, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        # A node is left out if any round has found it.
        seen = reduce(DataFrame.union, found).select("node")
        found.append(stored(ends.join(seen, "node", "left_anti").withColumn("steps", F.lit(len(found)).cast("long")), "reached"))
    return reduce(DataFrame.union, found)

"""Retrieval over points, relational documents, labels and stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.operators.vectors import Collection, nearest
from lakeseed.workspace import stored


def retrieve(
    points: DataFrame,
    queries: DataFrame,
    documents: DataFrame,
    labels: DataFrame,
    objects: DataFrame,
    collection: Collection,
    k: int,
) -> DataFrame:
    """Nearest documents of each query with their fields, label and stored object.

    ``documents`` are keyed by ``doc_id`` and name their object by ``bucket`` and ``key``;
    ``objects`` is a manifest. A document whose object is not stored has null object
    fields, and points without a document are left out. The hits, ``k`` per query, are
    written before anything is joined, so the planner knows their size and reads the
    large sides past them without a shuffle while they are few.
    """
    hits = stored(nearest(points, queries, collection, k), "hits").withColumnRenamed("id", "doc_id")
    found = hits.join(documents, "doc_id").join(labels, "doc_id", "left")
    manifest = objects.select(
        F.col("bucket").alias("object_bucket"),
        F.col("key").alias("object_key"),
        F.col("length").alias("object_length"),
        "content_type",
    )
    same = (F.col("bucket") == F.col("object_bucket")) & (F.col("key") == F.col("object_key"))
    return found.join(manifest, same, "left").drop("bucket", "key")

"""Approximate nearest neighbours: vectors in cells around centres, of which a query searches the nearest.

The exact search of ``vectors.nearest`` stays the default; this one reads only a share of the rows of a large collection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.operators.vectors import RANK_GROUPS, Collection
from lakeseed.workspace import stored

#: Centres are found on about this many rows; every row is put in a cell.
SAMPLE_ROWS = 50_000
MOST_CELLS = 4096
#: Rows, and queries, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


@dataclass(frozen=True)
class CellIndex:
    """The centres, a row each, the stored points (id, vector, cell, slice), and how many slices each cell has."""

    collection: Collection
    centres: np.ndarray
    points: DataFrame
    slices: DataFrame


def _matrix(vectors: pa.Array, collection: Collection) -> np.ndarray:
    if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != collection.size).any():
        raise ValueError(f"vector is not of size {collection.size}")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, collection.size).astype(np.float64)
    if not np.isfinite(rows).all():
        raise ValueError("vector holds something other than finite numbers")
    if collection.metric == "cosine":
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = rows / np.where(length > 0, length, 1)
    return rows


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, of unit vectors for the cosine."""
    return (rows**2).sum(1)[:, None] - 2 * rows @ others.T + (others**2).sum(1)[None]


def _near_cells(rows: DataFrame, name: str, collection: Collection, centres: np.ndarray, probes: int) -> DataFrame:
    """The rows (name, vector) with each of their nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[name].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("vector"), collection)
            distances = _distances(matrix, sent.value)
            cells = np.argpartition(distances, probes - 1, axis=1)[:, :probes] if probes < len(sent.value) else np.argsort(distances, axis=1)
            of = np.repeat(np.arange(len(matrix)), cells.shape[1])
            unit = pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * collection.size, pa.array(matrix.ravel()))
            columns = [batch.column(name).take(pa.array(of)), unit.take(pa.array(of)), pa.array(cells.ravel().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "vector", "cell"])

    return rows.select(name, "vector").mapInArrow(near, f"{name} {kind}, vector array<double>, cell long")


def build_index(points: DataFrame, collection: Collection, cells: int | None = None, seed: int = 7) -> CellIndex:
    """Every point (id, vector) in the cell of its nearest centre.

    As many cells as the square root of the points, ``MOST_CELLS`` at most. A cell of any size is cut in
    slices of about ``BLOCK_ROWS`` rows, so a cell may hold a third of all points.
    """
    if collection.metric == "dot":
        raise ValueError("cells hold vectors by distance; a dot product has none")
    count = points.count()
    cells = max(1, min(cells or int(count**0.5), MOST_CELLS, count))
    share = min(1.0, SAMPLE_ROWS / max(count, 1))
    if share < 1:
        drawn = points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    else:
        drawn = points
    unit = _near_cells(drawn, "id", collection, np.zeros((1, collection.size)), 1)
    unit = stored(unit.select(array_to_vector("vector").alias("features")), "sample")
    if unit.isEmpty():
        centres = np.zeros((1, collection.size))
    else:
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters()) if cells > 1 else np.zeros((1, collection.size))
    placed = stored(_near_cells(points, "id", collection, centres, 1), "placed")
    sizes = placed.groupBy("cell").agg(F.expr(f"(count(*) + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}").alias("slices"))
    # A row for each cell.
    sizes = stored(sizes, "cells")
    sliced = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).drop("slices")
    return CellIndex(collection, centres, stored(sliced, "index"), sizes)


def nearest_in_cells(index: CellIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, rank, id, score: about the k nearest points of each query, searched in the ``probes`` nearest cells.

    Blocks of a cell's points meet blocks of the queries that search the cell; each pair of blocks is a task's
    work and leaves k rows a query. Scores are exact; ties go to the smaller id. With as many probes as
    cells the result is that of the exact search.
    """
    if k <= 0 or probes <= 0:
        raise ValueError("k and probes must be positive")
    collection = index.collection
    probed = stored(_near_cells(queries, "query_id", collection, index.centres, min(probes, len(index.centres))), "probes")
    blocks = probed.groupBy("cell").agg(F.expr(f"(count(*) + {BLOCK_QUERIES - 1}) div {BLOCK_QUERIES}").alias("blocks"))
    blocks = stored(blocks.join(index.slices, "cell"), "blocks")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
    asked = probed.join(F.broadcast(blocks), "cell").withColumn("block", block)
    asked = asked.select("query_id", "vector", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    held = index.points.join(F.broadcast(blocks), "cell")
    held = held.select("id", "vector", "cell", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    kinds = [frame.schema[name].dataType.simpleString() for frame, name in ((queries, "query_id"), (index.points, "id"))]
    metric = collection.metric

    def best(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame(columns=["query_id", "id", "score"])
        points = points.sort_values("id", ignore_index=True)
        rows, wanted = np.stack(points.vector.to_numpy()), np.stack(asked.vector.to_numpy())
        scores = wanted @ rows.T if metric == "cosine" else -np.sqrt(np.maximum(_distances(wanted, rows), 0))
        kept = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        of = np.repeat(np.arange(len(asked)), kept.shape[1])
        found = {"query_id": asked.query_id.to_numpy()[of], "id": points.id.to_numpy()[kept.ravel()], "score": scores[of, kept.ravel()]}
        return pd.DataFrame(found)

    keys = ["cell", "slice", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    found = found.withColumn("_group", F.spark_partition_id() % RANK_GROUPS)
    order = [F.desc("score"), F.col("id")]
    for by in (["query_id", "_group"], ["query_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    score = -F.col("score") if metric == "euclidean" else F.col("score")
    return found.select("query_id", "rank", "id", score.alias("score"))

"""Vector collections: dimension checks and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

# Metric names; a blank metric means cosine.
METRICS = {"": "cosine", "cosine": "cosine", "dot": "dot", "euclidean": "euclidean"}

# Queries that a task holds at a time: the size limit of a block that is sent to every task.
QUERY_BYTES = 32 * 1024 * 1024
# Groups of tasks whose results are ranked first, so that no query's rows of all tasks meet at once.
RANK_GROUPS = 64
# Score cells that one task computes at a time (rows of a batch times queries).
SCORE_CELLS = 2_000_000
# Pairs that one task scores exactly at a time.
PAIRS = 100_000


def metric_name(metric: str) -> str:
    name = METRICS.get(metric.lower())
    if name is None:
        raise ValueError(f"unknown metric {metric!r}")
    return name


@dataclass(frozen=True)
class Collection:
    """A vector collection: name, vector size and distance metric."""

    name: str
    size: int
    metric: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("collection name is required")
        object.__setattr__(self, "metric", metric_name(self.metric))

    def checked(self, points: DataFrame, vector: str = "vector") -> DataFrame:
        """The points, failing the job on a vector of another size."""
        fits = F.coalesce(F.size(vector) == self.size, F.lit(False))
        message = F.concat(F.lit(f"vector in {self.name} is not of size {self.size}"))
        return points.withColumn(
            vector, F.when(fits, F.col(vector)).otherwise(F.raise_error(message))
        )

    def size_report(self, points: DataFrame, vector: str = "vector") -> DataFrame:
        """Count of points by whether their vector has the collection's size."""
        fits = F.coalesce(F.size(vector) == self.size, F.lit(False))
        return points.groupBy(fits.alias("fits")).agg(F.count(F.lit(1)).alias("points"))


def plain_id(rows: DataFrame, column: str) -> DataFrame:
    """Ids as whole numbers where they are, as text otherwise."""
    whole = isinstance(rows.schema[column].dataType, T.IntegralType)
    return rows.withColumn(column, F.col(column).cast("bigint" if whole else "string"))


def _scale(vectors: np.ndarray) -> np.ndarray:
    """For each vector the power of two at or below its largest entry, a very small one for zero."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    return np.ldexp(1.0, np.frexp(np.maximum(largest, 2.0**-1000))[1] - 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; zero vectors stay zero. Scaled first, so squares stay in range."""
    vectors = vectors / _scale(vectors)[:, None]
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths != 0)


def _pair_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Score of each pair of rows; larger is nearer, less the distance if euclidean.

    Summed row by row, so copies of a vector score the same wherever they are stored.
    """
    if metric == "euclidean":
        scale = np.maximum(_scale(left), _scale(right))
        apart = left / scale[:, None] - right / scale[:, None]
        return -scale * np.sqrt((apart**2).sum(axis=1))
    return (left * right).sum(axis=1)


def _rough_scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for every query and row by one matrix product, with a bound of the error of each.

    All vectors are brought to one scale first; what a query's distances lose by that is
    less than the bound.
    """
    if metric != "euclidean":
        size = np.abs(queries).max(axis=1, initial=0.0)[:, None] * np.abs(rows).max(axis=1, initial=0.0)[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            return queries @ rows.T, 1e-12 * queries.shape[1] * size
    scale = max(_scale(queries).max(initial=1e-300), _scale(rows).max(initial=1e-300))
    queries, rows = queries / scale, rows / scale
    sums = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :]
    squares = np.maximum(sums - 2 * (queries @ rows.T), 0.0)
    distances = np.sqrt(squares)
    lost = 1e-12 * sums
    return -scale * distances, scale * (np.sqrt(squares + lost) - np.sqrt(np.maximum(squares - lost, 0.0)) + 1e-300)


def _near_pairs(rough: np.ndarray, error: np.ndarray, floor: np.ndarray, k: int):
    """Query and row of each pair that may be among the best k of its query."""
    needed = floor.copy()
    open_queries = np.isneginf(floor)
    if open_queries.any() and rough.shape[1] > k:
        sure = rough[open_queries] - error[open_queries]
        needed[open_queries] = np.partition(sure, -k, axis=1)[:, -k]
    return np.nonzero(~(rough + error < needed[:, None]))


def _merge(best: tuple, found: tuple, k: int) -> tuple:
    """Order queries, ids and scores by query, score and id, and keep k of each query."""
    places, ids, scores = (np.concatenate(pair) for pair in zip(best, found))
    tie = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((tie, -scores, places))
    places, ids, scores = places[order], ids[order], scores[order]
    kept = np.arange(len(places)) - np.searchsorted(places, places) < k
    return places[kept], ids[kept], scores[kept]


def _scan(query_ids: list, matrix: np.ndarray, metric: str, k: int, whole_ids: bool, schema: pa.Schema):
    """Task function: the best k rows of one partition for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, size = matrix.shape
        queries = _unit(matrix) if metric == "cosine" else matrix
        step = max(1, SCORE_CELLS // count)
        id_type = np.int64 if whole_ids else object
        best = (np.empty(0, np.int64), np.empty(0, id_type), np.empty(0))
        # The score of the k-th row, for queries that have k rows.
        floor = np.full(count, -np.inf)
        for batch in batches:
            vectors = batch.column(1)
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != size).any():
                raise ValueError(f"vector is not of size {size}")
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            all_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(id_type)
            for start in range(0, len(all_ids), step):
                rows = values[start : start + step].astype(np.float64)
                ids = all_ids[start : start + step]
                if not np.isfinite(rows).all():
                    raise ValueError("vector holds something other than finite numbers")
                rows = _unit(rows) if metric == "cosine" else rows
                places, columns = _near_pairs(*_rough_scores(queries, rows, metric), floor, k)
                for pair in range(0, len(places), PAIRS):
                    place, column = places[pair : pair + PAIRS], columns[pair : pair + PAIRS]
                    scores = _pair_scores(queries[place], rows[column], metric)
                    kept = scores >= floor[place]
                    best = _merge(best, (place[kept], ids[column[kept]], scores[kept]), k)
                    full = np.flatnonzero(np.bincount(best[0], minlength=count) == k)
                    floor[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
        places, ids, scores = best
        names = pa.array(query_ids, schema.field(0).type).take(pa.array(places, pa.int64()))
        found = [names, pa.array(ids.tolist(), schema.field(1).type), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(found, schema=schema)

    return run


def _query_blocks(queries: DataFrame, size: int, limit: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of all queries, in blocks of at most ``limit`` bytes, one query at least."""
    ids, vectors, held, seen = [], [], 0, set()
    for row in queries.toLocalIterator():
        vector = np.array(row["vector"], dtype=np.float64)
        if vector.shape != (size,) or not np.isfinite(vector).all():
            raise ValueError(f"query vectors must hold {size} finite numbers")
        if row["query_id"] in seen:
            raise ValueError("query ids must differ")
        seen.add(row["query_id"])
        if held and held + vector.nbytes + len(str(row["query_id"])) > limit:
            yield ids, np.array(vectors)
            ids, vectors, held = [], [], 0
        ids.append(row["query_id"])
        vectors.append(vector)
        held += vector.nbytes + len(str(row["query_id"]))
    if ids:
        yield ids, np.array(vectors)


def nearest(
    points: DataFrame,
    queries: DataFrame,
    collection: Collection,
    k: int,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Exact k nearest points of each query: ``query_id, rank, id, score``.

    ``points`` has ``id`` and ``vector``, ``queries`` has ``query_id`` and ``vector``.
    Each task keeps its best k per query while it reads, so only k rows per query and
    partition are shuffled, and these are ranked in two steps. The queries are a stated
    set that is held in blocks of at most ``query_bytes``; one job scans the points for
    all blocks. Ties go to the smaller id.
    """
    points = plain_id(points, "id")
    queries = plain_id(queries, "query_id").select("query_id", "vector")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", points.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    whole_ids = schema["id"].dataType == T.LongType()
    arrow = to_arrow_schema(schema)
    scans = [
        _scan(ids, matrix, collection.metric, k, whole_ids, arrow)
        for ids, matrix in _query_blocks(queries, collection.size, query_bytes)
    ]
    if not scans:
        empty = points.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).alias("rank"), "id", "score")
    rows = points.select("id", "vector")
    candidates = reduce(DataFrame.union, [rows.mapInArrow(scan, schema) for scan in scans])
    candidates = candidates.withColumn("_group", F.spark_partition_id() % RANK_GROUPS)
    order = [F.desc("score"), F.col("id")]
    for keys in (["query_id", "_group"], ["query_id"]):
        ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        candidates = ranked.where(F.col("rank") <= k)
    score = -F.col("score") if collection.metric == "euclidean" else F.col("score")
    return candidates.select("query_id", "rank", "id", score.alias("score"))

"""The folder every executor can reach, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# With this a job deletes its own shuffle files when it ends; else they stay until the driver happens to collect garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders that this process has made below the shared folder.
MADE: list[str] = []
# The folders of the frames that ``stored`` has returned.
PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    A machine-local folder is made only in local mode, where driver and executors
    are one process; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder all executors share")
        root = tempfile.mkdtemp(prefix="lakeseed-")
        spark.conf.set(CHECKPOINT_SETTING, root)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    MADE.append(f"{shared_root(spark)}/lakeseed/{label}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove_made(spark: SparkSession) -> None:
    """Delete all folders made by this process, when no frame that reads them is used any more."""
    while MADE:
        store, place = _hadoop(spark, MADE.pop())
        store.delete(place, True)


def _hadoop(spark: SparkSession, path: str):
    """Spark's own file system for a path, with the session's endpoints and credentials."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it, for use inside tasks."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    if path.startswith("s3a://"):
        path = "s3://" + path.removeprefix("s3a://")
    return fs.FileSystem.from_uri(path)


def full_path(spark: SparkSession, path: str) -> str:
    """A path with the store that Spark takes it to be in, as a URI."""
    store, place = _hadoop(spark, path)
    return store.makeQualified(place).toUri().toString()


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _hadoop(spark, path)
    return store.exists(place) and store.getFileStatus(place).isDirectory()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path whose folder exists, so that it can be read before anything is in it."""
    path = new_path(spark, label)
    store, place = _hadoop(spark, path)
    store.mkdirs(place)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end, and so do frames made inside when they are collected.

    A write's shuffles are its own; no other job reads them. A frame is to be collected once.
    """
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_SETTING) if before is None else spark.conf.set(CLEANUP_SETTING, before)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write the rows to a fresh Parquet path and return a frame that reads it.

    Cuts the lineage where rows are used more than once; lost executors do no harm. What the write has
    shuffled is deleted at once.
    """
    path = new_path(rows.sparkSession, label)
    with shuffles_removed(rows.sparkSession):
        rows.write.parquet(path)
    made = rows.sparkSession.read.parquet(path)
    PLACES[made] = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` has written for these frames, when no frame that reads it is used any more."""
    for rows in frames:
        path = PLACES.pop(rows)
        store, place = _hadoop(rows.sparkSession, path)
        store.delete(place, True)
        MADE.remove(path)


def bucketed(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Like ``stored``, in buckets by a column, so that later steps by that column exchange nothing of the rows."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", new_path(spark, label)
    with shuffles_removed(spark):
        rows.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    made = spark.table(name)
    # The frame keeps its files and buckets; the name is not needed any more.
    spark.sql(f"DROP TABLE {name}")
    return made

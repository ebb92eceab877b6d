"""Objects: put bytes under bucket and key, read and stat them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.functions.scalars import first_filled
from lakeseed.operators.write import filled_or_error, last_wins
from lakeseed.workspace import file_system, full_path, is_folder, stored

# Fixed value: content type of an object that was put without one.
DEFAULT_TYPE = "application/octet-stream"
# A put waits for its remote store, so a task has several under way.
PUTS_AT_ONCE = 8
GETS_AT_ONCE = 8
# Bytes of content that a task reads at a time, and in all.
READ_BYTES = 32 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
# Rows that a task lists at a time.
LIST_ROWS = 10_000
# The folder beside the buckets that holds the manifests.
MANIFESTS = "_manifest"
WRITTEN = "bucket string, key string, content_type string, length bigint"
MANIFEST = f"{WRITTEN}, put_at bigint"
MANIFEST_COLUMNS = ["bucket", "key", "content_type", "length", "put_at"]
READ = "bucket string, key string, length bigint, content_type string, content binary"
LISTED = "place string, length bigint, is_folder boolean"


# Fixed patterns: file names that Spark's listings would hide or Hadoop paths refuse.
ESCAPES = [("%", "%25"), (":", "%3A"), (r"(^|/)_", "$1%5F"), (r"(^|/)\.", "$1%2E")]
PATH_DEFECT = r"(^|/)(/|$)"


def _stored_name(name: Column) -> Column:
    """File name of an object: hidden and awkward parts are escaped, read back exactly."""
    escaped = reduce(lambda done, pair: F.regexp_replace(done, *pair), ESCAPES, name)
    message = F.concat(F.lit("object name has an empty part: "), name)
    return F.when(name.rlike(PATH_DEFECT), F.raise_error(message).cast("string")).otherwise(escaped)


def _writer(root: str, create_buckets: bool):
    """Task function: write the objects of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        known_buckets: set[str] = set()
        made: set[str] = set()

        def put(bucket: pa.Scalar, path: pa.Scalar, content: pa.Scalar) -> int:
            folder = f"{base}/{bucket}"
            if not create_buckets and folder not in known_buckets:
                if store.get_file_info(folder).type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"bucket {bucket} does not exist")
                known_buckets.add(folder)
            target = f"{folder}/{path}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            data = content.as_buffer()
            # A task may run twice: write aside, then move over the target at once.
            aside = f"{parent}/_{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as stream:
                stream.write(data)
            store.move(aside, target)
            return data.size

        with ThreadPoolExecutor(PUTS_AT_ONCE) as pool:
            each = map if store.type_name == "local" else pool.map
            for batch in batches:
                columns = [batch.column(name) for name in ("folder", "path", "content")]
                lengths = pa.array(list(each(put, *columns)), pa.int64())
                kept = [batch.column(name) for name in ("bucket", "key", "content_type")]
                names = ["bucket", "key", "content_type", "length"]
                yield pa.RecordBatch.from_arrays([*kept, lengths], names=names)

    return run


def _reader(root: str):
    """Task function: add the content of one partition's objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)

        def get(place: pa.Scalar) -> bytes:
            with store.open_input_stream(f"{base}/{place}") as stream:
                return stream.read()

        with ThreadPoolExecutor(GETS_AT_ONCE) as pool:
            for batch in batches:
                for start, end in _slices(batch.column("length").to_pylist()):
                    part = batch.slice(start, end - start)
                    found = list(pool.map(get, part.column("place")))
                    kept = [part.column(name) for name in ("bucket", "key", "length", "content_type")]
                    names = ["bucket", "key", "length", "content_type", "content"]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=names)

    return run


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of objects of about ``READ_BYTES`` in all, one object at least."""
    start, held = 0, 0
    for end, length in enumerate(lengths):
        if held and held + length > READ_BYTES:
            yield start, end
            start, held = end, 0
        held += length
    if lengths:
        yield start, len(lengths)


def _hidden(name: str, is_folder: bool) -> bool:
    """Whether Spark's file sources pass over a name."""
    if name.endswith("._COPYING_") or name.startswith("."):
        return True
    return name.startswith("_") and "=" not in name and not (is_folder and name.startswith(("_metadata", "_common_metadata")))


def _lister(root: str):
    """Task function: what lies in folders below a root, a level at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for batch in batches:
            for folder in batch.column("place").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                for start in range(0, len(found), LIST_ROWS):
                    part = [(x.base_name, x.size, x.type == fs.FileType.Directory) for x in found[start : start + LIST_ROWS] if x.type != fs.FileType.NotFound]
                    part = [(f"{folder}/{name}".lstrip("/"), size, kind) for name, size, kind in part if not _hidden(name, kind)]
                    columns = [pa.array(column, kind) for column, kind in zip(zip(*part), (pa.string(), pa.int64(), pa.bool_()))]
                    if columns:
                        yield pa.RecordBatch.from_arrays(columns, names=["place", "length", "is_folder"])

    return run


def _files_below(spark: SparkSession, root: str) -> DataFrame:
    """place (below the root) and length of every file of a folder. Tasks list its folders, one level after the other."""
    found, level = [], spark.createDataFrame([("",)], "place string")
    while True:
        spread = level.repartition(spark.sparkContext.defaultParallelism, "place")
        entries = stored(spread.mapInArrow(_lister(root), LISTED), "listed")
        found.append(entries.where("not is_folder and length > 0").select("place", "length"))
        level = entries.where("is_folder").select("place")
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def _spread(known: DataFrame, *keys: str) -> DataFrame:
    """What is to be read, dealt out to tasks of about ``TASK_BYTES``."""
    total = known.agg(F.sum("length")).first()[0] or 0
    cores = known.sparkSession.sparkContext.defaultParallelism
    return known.repartition(max(cores, -(-total // TASK_BYTES)), *keys)


def put_objects(
    objects: DataFrame,
    root: str,
    seq: list[str] | None = None,
    create_buckets: bool = True,
    batch_id: str = "",
) -> DataFrame:
    """Write each object to ``root/bucket/key`` and return the manifest of the batch.

    ``objects`` has ``bucket, key, content`` (text or bytes) and may have
    ``content_type``. Keys that occur more than once need ``seq`` to tell which is the
    last; without it they are refused. Tasks write their own rows; no object passes
    through the driver. Every put adds its own manifest; a put that is repeated with the
    same ``batch_id`` replaces the manifest that it wrote before.
    """
    spark = objects.sparkSession
    names = ["bucket", "key"]
    if seq is None and not objects.groupBy(*names).count().where("count > 1").isEmpty():
        raise ValueError("objects that share bucket and key need seq columns that order them")
    kind = F.col("content_type") if "content_type" in objects.columns else F.lit("")
    chosen = last_wins(objects, names, seq) if seq else objects
    rows = chosen.select(
        filled_or_error(
            F.when(~F.col("bucket").contains("/"), F.col("bucket")), "bucket name is required, without a slash"
        ).alias("bucket"),
        filled_or_error(F.col("key"), "object key is required").alias("key"),
        F.col("content").cast("binary").alias("content"),
        first_filled(kind, F.lit(DEFAULT_TYPE)).alias("content_type"),
    )
    put_at = time.time_ns()
    manifest = f"{root}/{MANIFESTS}/batch={batch_id or f'{put_at}-{uuid.uuid4().hex}'}"
    written = _placed(rows).mapInArrow(_writer(root, create_buckets), WRITTEN)
    written.withColumn("put_at", F.lit(put_at)).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest).drop("put_at")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with the folder and path of each object below the root."""
    return rows.withColumns(
        {"folder": _stored_name(F.col("bucket")), "path": _stored_name(F.col("key"))}
    )


def stat_objects(spark: SparkSession, root: str) -> DataFrame:
    """Bucket, key, length and content type of every object, from the manifests of all puts."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/{MANIFESTS}")
    return last_wins(rows.select(*MANIFEST_COLUMNS), ["bucket", "key"], ["put_at"]).drop("put_at")


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """All objects below a root: ``bucket, key, length, content_type, content``.

    The manifests tell tasks what to read; nothing is listed.
    """
    place = F.concat("folder", F.lit("/"), "path").alias("place")
    known = _placed(stat_objects(spark, root)).select("bucket", "key", "length", "content_type", place)
    return _spread(known, "bucket", "key").mapInArrow(_reader(root), READ)


def file_objects(spark: SparkSession, path: str, bucket: str, prefix: str = "", content_type: str = "") -> DataFrame:
    """The files below a path as objects to put: their keys are their paths below it, after a prefix.

    Tasks list a folder and read its files, so the driver holds no list of them. Single files, patterns and
    stores that only Spark's own readers open are listed by Spark, on the driver. Empty files are passed over.
    """
    if is_folder(spark, path):
        root = full_path(spark, path)
        if _opens(root):
            known = _files_below(spark, root).select(
                F.lit(bucket).alias("bucket"), F.concat(F.lit(prefix), "place").alias("key"), "length", F.lit(content_type).alias("content_type"), "place"
            )
            return _spread(known, "place").mapInArrow(_reader(root), READ).select("bucket", "key", "content", "content_type")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = F.regexp_extract("path", "[^/]+$", 0)
    if is_folder(spark, path):
        below = path.rstrip("/").split("://")[-1].split(":")[-1].rstrip("/")
        whole = F.regexp_extract("path", rf"(?s)\Q{below}\E/(.*)$", 1)
    key = F.concat(F.lit(prefix), whole)
    return files.select(
        F.lit(bucket).alias("bucket"), key.alias("key"), "content", F.lit(content_type).alias("content_type")
    )


def _opens(root: str) -> bool:
    """Whether tasks can open the store of a path by themselves."""
    try:
        file_system(root)
    except (pa.ArrowException, OSError):
        return False
    return True

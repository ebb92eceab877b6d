"""Sources and sinks: objects, manifests, logs and lake tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.sources.files import read_logs, read_manifests
from lakeseed.sources.lake import LakeEnvironment, create_lake_table, insert_lake_rows
from lakeseed.sources.objects import file_objects, put_objects, read_objects, stat_objects
from lakeseed.sources.tables import read_table
from lakeseed.workspace import new_path


def document_objects(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(
        F.col("lang").alias("bucket"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("key"),
        F.col("text").alias("content"),
        F.lit("text/plain").alias("content_type"),
    )


def object_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All document texts are written as objects and read back."""
    root = new_path(spark, "objects")
    put_objects(document_objects(spark, folder), root)
    return read_objects(spark, root).select("bucket", "key", "length", "content_type", F.md5("content").alias("md5"))


def object_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one language's folder are put as objects of one bucket, after a first put of other ones."""
    files, root = new_path(spark, "files"), new_path(spark, "objects")
    documents = document_objects(spark, folder)
    put_objects(documents, files)
    put_objects(documents.where("bucket <> 'en'").withColumn("content_type", F.lit("")), root)
    put_objects(file_objects(spark, f"{files}/en", "en", "copy/", "text/markdown"), root)
    return read_objects(spark, root).groupBy("bucket", "content_type").agg(
        F.count(F.lit(1)).alias("objects"), F.sum(F.octet_length("content")).alias("bytes"), F.min("key").alias("first_key")
    )


def object_stat(spark: SparkSession, folder: str) -> DataFrame:
    """Documents are put in two batches, the second one over a part of the first."""
    root = new_path(spark, "objects")
    documents = document_objects(spark, folder)
    put_objects(documents, root)
    put_objects(documents.where("bucket = 'de'").withColumn("content", F.upper("bucket")), root)
    return stat_objects(spark, root).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum("length").alias("bytes"),
        F.max("length").alias("largest"),
    )


def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents become files with a suffix per language; only two suffixes are read."""
    suffix = F.when(F.col("lang") == "fr", ".yaml").when(F.col("lang") == "de", ".yml").otherwise(".txt")
    rows = read_table(spark, folder, "documents").select(
        F.lit("manifests").alias("bucket"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("key"),
        F.col("text").alias("content"),
    )
    root = new_path(spark, "manifests")
    put_objects(rows, root)
    return read_manifests(spark, f"{root}/manifests").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.length("text").cast("bigint").alias("chars"),
        F.md5("text").alias("md5"),
    )


def log_union(spark: SparkSession, folder: str) -> DataFrame:
    """Three tables are written as line logs and read back as one frame."""
    lines = {
        "events": F.concat_ws(" ", "event_id", "user_id", "event_type"),
        "conversations": F.col("text"),
        "documents": F.col("text"),
    }
    paths = {}
    for name, line in lines.items():
        paths[name] = new_path(spark, f"log-{name}")
        read_table(spark, folder, name).select(line.alias("value")).write.text(paths[name])
    return read_logs(spark, paths).groupBy("service").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")
    )


def lake_table(spark: SparkSession, folder: str) -> DataFrame:
    """Events go into a table partitioned by type; the read skips the other partitions."""
    path_id = new_path(spark, "id").rsplit("-", 1)[-1]
    events = read_table(spark, folder, "events")
    table = create_lake_table(spark, LakeEnvironment(), f"events_{path_id}", events, "event_type")
    insert_lake_rows(events, table, "event_type")
    purchases = spark.table(table).where(F.col("event_type") == "purchase")
    return purchases.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


QUERIES = {
    "object_roundtrip": object_roundtrip,
    "object_files": object_files,
    "object_stat": object_stat,
    "manifest_files": manifest_files,
    "log_union": log_union,
    "lake_table": lake_table,
}

CHECKS = {
    "object_roundtrip": """
SELECT lang AS bucket, source || '/' || doc_id || '.txt' AS key, strlen(text) AS length,
       'text/plain' AS content_type, md5(text) AS md5 FROM documents""",
    "object_files": """
SELECT lang AS bucket, CASE lang WHEN 'en' THEN 'text/markdown' ELSE 'application/octet-stream' END AS content_type,
       count(*) AS objects, sum(strlen(text))::BIGINT AS bytes,
       min(CASE lang WHEN 'en' THEN 'copy/' ELSE '' END || source || '/' || doc_id || '.txt') AS first_key
FROM documents GROUP BY 1""",
    "object_stat": """
SELECT lang AS bucket, count(*) AS objects, sum(size)::BIGINT AS bytes, max(size) AS largest
FROM (SELECT lang, CASE lang WHEN 'de' THEN 2 ELSE strlen(text) END AS size FROM documents) GROUP BY 1""",
    "manifest_files": """
SELECT doc_id || CASE lang WHEN 'fr' THEN '.yaml' ELSE '.yml' END AS name, length(text) AS chars, md5(text) AS md5
FROM documents WHERE lang IN ('fr', 'de')""",
    "log_union": """
WITH logs AS (
  SELECT 'events' AS service, event_id || ' ' || user_id || ' ' || event_type AS text FROM events
  UNION ALL SELECT 'conversations', text FROM conversations
  UNION ALL SELECT 'documents', text FROM documents)
SELECT service, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
       sum(length(replace(text, chr(10), '')))::BIGINT AS chars
FROM logs GROUP BY 1""",
    "lake_table": """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events, round(sum(value), 2) AS total
FROM events WHERE event_type = 'purchase' GROUP BY 1""",
}

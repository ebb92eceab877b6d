"""Scalar, array, map and JSON functions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.functions import scalars as S
from lakeseed.sources.tables import read_table

ENDPOINT = "http://gateway:4566"


def env_key(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    blank_some = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return documents.select("doc_id", S.env_key(blank_some, F.col("source"), F.col("text")).alias("env_key"))


def rewrite_endpoint(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    without_scheme = F.regexp_replace("url", "^https?://", "")
    return pages.select(
        "page_id",
        S.rewrite_endpoint(F.col("url"), ENDPOINT).alias("rewritten"),
        S.rewrite_endpoint(without_scheme, ENDPOINT).alias("unchanged"),
    )


def strip_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses have a host in front; document paths with their texts have none."""
    pages = read_table(spark, folder, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", ""), F.lit("\n")).alias("image"),
    )
    documents = read_table(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", "lang", "text").alias("image"),
    )
    both = pages.unionByName(documents)
    return both.select(
        "kind", "id",
        S.strip_registry(F.col("image")).alias("path"),
        S.registry_image(F.col("image"), "127.0.0.1:5005").alias("pushed"),
    )


def resource_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings that tell an application its queues and topics.

    Queue addresses are moved to the endpoint the application sees; topic names are
    not addresses and stay.
    """
    pages = read_table(spark, folder, "pages")
    documents = read_table(spark, folder, "documents")
    queues = pages.select(
        S.env_key(F.lit("SQS"), F.col("url"), F.lit("URL")).alias("key"),
        S.rewrite_endpoint(F.col("url"), ENDPOINT).alias("value"),
    )
    topic = F.concat_ws(":", F.lit("arn:aws:sns:us-east-1:000000000000"), "source", "doc_id")
    topics = documents.select(
        S.env_key(F.lit("SNS"), F.concat_ws("-", "source", "doc_id"), F.lit("ARN")).alias("key"),
        topic.alias("value"),
    )
    return queues.unionByName(topics)


def map_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's settings, overlaid by its label's where it has one."""
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = read_table(spark, folder, "labels")
    base = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("quality"), F.lit("unknown"))
    top = F.create_map(
        F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")
    )
    empty = F.create_map().cast("map<string,string>")
    merged = documents.join(labels, "doc_id", "left").select(
        "doc_id",
        S.overlay(base, F.when(F.col("quality").isNotNull(), top).otherwise(empty)).alias("settings"),
    )
    return merged.select(
        "doc_id",
        F.size("settings").alias("entries"),
        *[F.try_element_at("settings", F.lit(key)).alias(key) for key in ("lang", "source", "quality", "toxic")],
    )


def render_properties(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    properties = F.create_map(
        F.lit("order.status"), "o_orderstatus",
        F.lit("order"), F.col("o_orderkey").cast("string"),
        F.col("o_orderpriority"), F.col("o_custkey").cast("string"),
    )
    return orders.select("o_orderkey", S.property_lines(properties).alias("lines"))


def token_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each whole document, first occurrences in order."""
    documents = read_table(spark, folder, "documents")
    return documents.select("doc_id", S.unique_tokens(F.split("text", " ", -1)).alias("tokens"))


def coalesce_blank(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "text")
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    quality = F.when(F.col("quality") == 1, "good").otherwise("")
    english = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    joined = documents.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        S.first_filled(quality, english).alias("maybe"),
        S.first_filled(quality, english, F.col("text")).alias("filled"),
    )


def to_json_omit(spark: SparkSession, folder: str) -> DataFrame:
    """Objects as JSON with empty fields left out, read back field by field."""
    events = read_table(spark, folder, "events")
    note = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    tags = F.when(F.col("event_type") == "click", F.array("event_type")).otherwise(F.array().cast("array<string>"))
    text = S.json_without_blanks({"id": F.col("event_id")}, texts={"note": note}, nested={"tags": tags})
    document = events.select("event_id", text.alias("json")).withColumn("doc", F.parse_json("json"))
    return document.select(
        "event_id",
        F.variant_get("doc", "$.id", "bigint").alias("id"),
        F.variant_get("doc", "$.note", "string").alias("note"),
        F.variant_get("doc", "$.tags[0]", "string").alias("tag"),
        F.col("json").contains('"note"').alias("has_note"),
        F.col("json").contains('"tags"').alias("has_tags"),
    )


def dsn_encode(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    dsn = S.document_store_dsn(F.lit("127.0.0.1:27017"), F.col("source"), F.col("text"), F.col("lang"))
    return documents.select("doc_id", dsn.alias("dsn"))


QUERIES = {
    "env_key": env_key,
    "rewrite_endpoint": rewrite_endpoint,
    "strip_registry": strip_registry,
    "resource_settings": resource_settings,
    "map_overlay": map_overlay,
    "render_properties": render_properties,
    "token_unique": token_unique,
    "coalesce_blank": coalesce_blank,
    "to_json_omit": to_json_omit,
    "dsn_encode": dsn_encode,
}

CHECKS = {
    "env_key": """
SELECT doc_id, upper(regexp_replace(CASE lang WHEN 'en' THEN '' ELSE lang || '_' END || source || '_' || text,
                                    '[^A-Za-z0-9]', '_', 'g')) AS env_key FROM documents""",
    "rewrite_endpoint": """
SELECT page_id, regexp_replace(url, '^https?://[^/?#]+', 'http://gateway:4566') AS rewritten,
       regexp_replace(url, '^https?://', '') AS unchanged FROM pages""",
    "strip_registry": """
SELECT *, '127.0.0.1:5005/' || path AS pushed FROM (
  SELECT 'page' AS kind, page_id AS id, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages
  UNION ALL
  SELECT 'document', doc_id, trim(source || '/' || lang || '/' || text, ' ' || chr(10)) FROM documents)""",
    "resource_settings": """
SELECT 'SQS_' || upper(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g')) || '_URL' AS key,
       regexp_replace(url, '^https?://[^/?#]+', 'http://gateway:4566') AS value FROM pages
UNION ALL
SELECT 'SNS_' || upper(source) || '_' || doc_id || '_ARN',
       'arn:aws:sns:us-east-1:000000000000:' || source || ':' || doc_id FROM documents""",
    "map_overlay": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 3 ELSE 4 END::INT AS entries, lang, source,
       coalesce(quality::VARCHAR, 'unknown') AS quality, toxic::VARCHAR AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "render_properties": """
SELECT o_orderkey, array_to_string(list_sort(['order.status=' || o_orderstatus, 'order=' || o_orderkey,
       o_orderpriority || '=' || o_custkey]), chr(10)) || chr(10) AS lines FROM orders""",
    "token_unique": """
WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                      generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
  trimmed AS (SELECT doc_id, trim(word, chr(10)) AS word, min(pos) AS pos FROM words GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(word, ',' ORDER BY pos) FILTER (word <> ''), '') AS tokens
FROM documents d LEFT JOIN trimmed t ON t.doc_id = d.doc_id GROUP BY 1""",
    "coalesce_blank": """
SELECT d.doc_id,
       coalesce(CASE WHEN quality = 1 THEN 'good' END, nullif(CASE lang WHEN 'en' THEN '' ELSE lang END, ''), '') AS maybe,
       coalesce(CASE WHEN quality = 1 THEN 'good' END, nullif(CASE lang WHEN 'en' THEN '' ELSE lang END, ''), text) AS filled
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "to_json_omit": """
SELECT event_id, event_id AS id, CASE WHEN event_type <> 'view' THEN event_type END AS note,
       CASE WHEN event_type = 'click' THEN event_type END AS tag,
       event_type <> 'view' AS has_note, event_type = 'click' AS has_tags FROM events""",
    "dsn_encode": """
SELECT doc_id, 'mongodb://' || source || ':' || replace(url_encode(text), '%20', '+') || '@127.0.0.1:27017/'
       || lang || '?authSource=admin' AS dsn FROM documents""",
}

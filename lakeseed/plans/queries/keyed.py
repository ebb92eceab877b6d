"""Keyed lookup, document filters, keyed ranges and typed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.classes import ObjectClass, Property, limited, typed_objects, validate
from lakeseed.operators.keyed import count_documents, key_range, key_ranges, keyed_table, lookup
from lakeseed.operators.write import append_batch, last_wins
from lakeseed.sources.documents import collection_path, insert_documents, read_documents
from lakeseed.sources.tables import read_table
from lakeseed.workspace import new_path


def kv_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each order looks up the last event of its customer; most customers have none."""
    events = read_table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "event_type", "value", "ts", "event_id"
    )
    pairs = last_wins(events, ["key"], ["ts", "event_id"]).select("key", "event_type", "value")
    probes = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return lookup(probes, pairs, "key")


def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    body = F.struct(F.col("event_type").alias("kind"), F.parse_json("props").alias("props"))
    return events.select(F.to_variant_object(body).alias("doc"))


def turn_documents(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations")
    return turns.select(F.to_variant_object(F.struct(F.col("role").alias("kind"), "turn", "text")).alias("doc"))


def document_append(spark: SparkSession, folder: str) -> DataFrame:
    """Events and conversation turns are appended to one collection; one batch runs twice."""
    path = collection_path(new_path(spark, "documents"), "messages")
    insert_documents(event_documents(spark, folder), path, "events")
    insert_documents(turn_documents(spark, folder), path, "turns")
    insert_documents(turn_documents(spark, folder), path, "turns")
    return read_documents(spark, path).groupBy(F.variant_get("doc", "$.kind", "string").alias("kind")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.try_variant_get("doc", "$.props.k", "bigint")).alias("k_sum"),
        F.sum(F.length(F.try_variant_get("doc", "$.text", "string"))).alias("chars"),
    )


def document_count(spark: SparkSession, folder: str) -> DataFrame:
    """Events are stored as documents and counted by two of their fields."""
    path = collection_path(new_path(spark, "documents"), "events")
    insert_documents(event_documents(spark, folder), path, "events")
    return count_documents(read_documents(spark, path), "doc", {"kind": "purchase", ("props", "k"): 69})


def keyed_range(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, the events between the first signup and the last purchase."""
    events = read_table(spark, folder, "events")
    path = new_path(spark, "items")
    keyed_table(events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts").write.parquet(path)
    items = spark.read.parquet(path)
    ranges = items.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("low"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("high"),
    )
    found = key_ranges(items.select("user_id", "ts", "event_id", "value"), ranges, "user_id", "ts")
    return found.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.sum("value"), 2).alias("total"),
        F.min("ts").cast("timestamp_ntz").alias("first_ts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
    )


def keyed_point(spark: SparkSession, folder: str) -> DataFrame:
    """Line items stored by return flag and day: one flag in two months of days."""
    lines = read_table(spark, folder, "lineitem")
    path = new_path(spark, "items")
    items = lines.withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    keyed_table(items.drop("l_shipdate"), "l_returnflag", "day").write.parquet(path)
    found = key_range(spark.read.parquet(path), "l_returnflag", "R", "day", "1997-03-01", "1997-04-30")
    return found.groupBy("day").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


EVENT = ObjectClass("Event", properties=[Property("k", ["int"]), Property("note", ["text"])])


def object_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties against ``k: int`` and ``note: text``.

    The note is the value, as text for purchases and as a number for clicks; errors
    bring a field that the class does not declare.
    """
    note = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit(', "note": "'), "value", F.lit('"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit(', "note": '), "value", F.lit("}")))
        .when(F.col("event_type") == "error", F.lit(', "code": 1}'))
        .otherwise("}")
    )
    rows = read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.parse_json(F.concat(F.regexp_replace("props", r"\}\s*$", ""), note)).alias("properties"),
    )
    checked = validate(typed_objects(rows, EVENT), EVENT)
    return checked.groupBy("class", "k_state", "note_state", "unknown_fields").agg(
        F.count(F.lit(1)).alias("objects")
    )


def object_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a vector become objects of one class, labels of another; both are stored."""
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    labels = read_table(spark, folder, "labels")
    path = new_path(spark, "classes")
    properties = F.to_variant_object(F.struct("lang", "n_chars")).alias("properties")
    with_vectors = documents.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("id"), properties, "vector")
    marks = F.to_variant_object(F.struct("quality", "toxic")).alias("properties")
    append_batch(typed_objects(with_vectors, ObjectClass("Document")), path, "documents")
    append_batch(typed_objects(labels.select(F.col("doc_id").alias("id"), marks), ObjectClass("Label")), path, "labels")
    return spark.read.parquet(path).select(
        "class", "id",
        F.try_variant_get("properties", "$.lang", "string").alias("lang"),
        F.try_variant_get("properties", "$.n_chars", "bigint").alias("n_chars"),
        F.try_variant_get("properties", "$.quality", "int").alias("quality"),
        F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dims"),
    )


def bytes_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Whole pages stored as bytes by key; documents look up theirs, most have none."""
    stored = read_table(spark, folder, "pages").select(
        F.concat(F.lit("page:"), "page_id").alias("key"), F.col("html").cast("binary").alias("value")
    )
    probes = read_table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("page:"), "doc_id").alias("key")
    )
    found = lookup(probes, stored, "key")
    return found.select("doc_id", "key", F.octet_length("value").alias("bytes"), F.md5("value").alias("md5"))


def default_limit(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return limited(orders, F.desc("o_totalprice"), "o_orderkey")


QUERIES = {
    "kv_lookup": kv_lookup,
    "document_append": document_append,
    "document_count": document_count,
    "keyed_range": keyed_range,
    "keyed_point": keyed_point,
    "object_validate": object_validate,
    "default_limit": default_limit,
    "object_insert": object_insert,
    "bytes_lookup": bytes_lookup,
}

CHECKS = {
    "kv_lookup": """
SELECT o_custkey AS key, o_orderkey, e.event_type, e.value
FROM orders LEFT JOIN (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
) e ON e.user_id = o_custkey""",
    "document_append": """
SELECT event_type AS kind, count(*) AS documents, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum,
       NULL::BIGINT AS chars FROM events GROUP BY 1
UNION ALL
SELECT role, count(*), NULL::BIGINT, sum(length(text))::BIGINT FROM conversations GROUP BY 1""",
    "document_count": """
SELECT count(*) AS documents FROM events WHERE event_type = 'purchase' AND (props->>'$.k')::BIGINT = 69""",
    "keyed_range": """
WITH ranges AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS low,
                       max(ts) FILTER (event_type = 'purchase') AS high FROM events GROUP BY 1)
SELECT e.user_id::VARCHAR AS user_id, count(*) AS items, round(sum(value), 2) AS total,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events e JOIN ranges r ON r.user_id = e.user_id AND ts BETWEEN low AND high GROUP BY 1""",
    "keyed_point": """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= '1997-03-01' AND l_shipdate < '1997-05-01' GROUP BY 1""",
    "object_validate": """
SELECT 'Event' AS class,
       CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'valid'
            WHEN json_type(props, '$.k') IS NULL THEN 'missing' ELSE 'wrong_type' END AS k_state,
       CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'click' THEN 'wrong_type' ELSE 'missing' END AS note_state,
       CASE event_type WHEN 'error' THEN 1 ELSE 0 END::INT AS unknown_fields,
       count(*) AS objects
FROM events GROUP BY 1, 2, 3, 4""",
    "object_insert": """
SELECT 'Document' AS class, doc_id::VARCHAR AS id, lang, n_chars, NULL::INT AS quality, len(embedding)::INT AS dims
FROM documents LEFT JOIN embeddings ON vec_id = doc_id
UNION ALL
SELECT 'Label', doc_id::VARCHAR, NULL, NULL, quality, NULL FROM labels""",
    "bytes_lookup": """
SELECT doc_id, 'page:' || doc_id AS key, strlen(html)::INT AS bytes, md5(html) AS md5
FROM documents LEFT JOIN pages ON page_id = doc_id""",
    "default_limit": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
}

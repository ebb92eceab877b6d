"""Write modes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.write import create_strict, insert_if_absent, owned_difference, put
from lakeseed.sources.tables import read_table
from lakeseed.workspace import new_path


def kv_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Customers are the stored pairs; every event sets the pair of its user."""
    base = read_table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("key"),
        F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("type"),
    )
    batch = read_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), "value",
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("type"),
        "ts", "event_id",
    )
    return put(base, batch, "key", ["ts", "event_id"])


def insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Customer keys are present; part keys of line items arrive, many times each."""
    base = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount")
    )
    incoming = read_table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("amount"),
        "l_shipdate", "l_orderkey", "l_linenumber",
    )
    return insert_if_absent(base, incoming, ["key"], ["l_shipdate", "l_orderkey", "l_linenumber", "amount"])


def owned(spark: SparkSession, folder: str) -> DataFrame:
    declared = read_table(spark, folder, "documents").select("doc_id", "lang", "source")
    return owned_difference(declared, read_table(spark, folder, "labels"), ["doc_id"])


def strict_create(spark: SparkSession, folder: str) -> DataFrame:
    """The first create stores the table, the second is refused and changes nothing."""
    path = new_path(spark, "strict")
    create_strict(read_table(spark, folder, "part"), path, "items")
    try:
        create_strict(read_table(spark, folder, "supplier"), path, "items")
        second = "accepted"
    except AnalysisException:
        second = "refused"
    stored = spark.read.parquet(f"{path}/items")
    return stored.groupBy("p_brand").agg(F.count(F.lit(1)).alias("items")).withColumn("second", F.lit(second))


QUERIES = {
    "kv_last_wins": kv_last_wins,
    "insert_if_absent": insert_absent,
    "owned_difference": owned,
    "strict_create": strict_create,
}

CHECKS = {
    "kv_last_wins": """
WITH latest AS (SELECT user_id::VARCHAR AS key, value,
                       CASE WHEN event_type = 'error' THEN 'String' ELSE event_type END AS type
                FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT key, value, type FROM latest
UNION ALL
SELECT c_custkey::VARCHAR, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey::VARCHAR NOT IN (SELECT key FROM latest)""",
    "insert_if_absent": """
SELECT c_custkey AS key, c_acctbal AS amount FROM customer
UNION ALL
SELECT key, amount FROM (
  SELECT l_partkey AS key, l_extendedprice AS amount FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey
                             ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) = 1)
WHERE key NOT IN (SELECT c_custkey FROM customer)""",
    "owned_difference": """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "strict_create": "SELECT p_brand, count(*) AS items, 'refused' AS second FROM part GROUP BY p_brand",
}

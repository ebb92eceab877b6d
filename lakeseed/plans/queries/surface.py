"""SQL that users forward: one query for each part of the SQL surface.

Most are the same text for Spark and for the check. Where a hot key would fill one
task, the Spark side uses an operator that splits it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.skew import last_before, ordered_scan
from lakeseed.plans.catalog import query
from lakeseed.sources.tables import TABLES, read_table, table_path

FORWARDED = {
    "p_filter_project": """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag <> 'R'""",
    "p_join_multiway": """
SELECT r_name, n_name, sum(orders) AS orders, round(sum(spent), 2) AS spent
FROM (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) spending
JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
GROUP BY r_name, n_name""",
    "p_semi_anti": """
SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'with' ELSE 'without' END AS kind,
       c_mktsegment, count(*) AS customers
FROM customer GROUP BY 1, c_mktsegment""",
    "p_group_agg": """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity,
       round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS discount
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "p_distinct": """
SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY event_type""",
    "p_rollup": """
SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level,
       count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
    "p_topk_group": """
SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
  FROM orders) ranked WHERE place <= 3""",
    "p_setops": """
SELECT explode(CASE WHEN documents = 0 THEN array('any') WHEN labels = 0 THEN array('any', 'unlabelled') ELSE array('any', 'both') END) AS kind, doc_id
FROM (SELECT doc_id, sum(document) AS documents, sum(label) AS labels
      FROM (SELECT doc_id, 1 AS document, 0 AS label FROM documents
            UNION ALL SELECT doc_id, 0 AS document, 1 AS label FROM labels) tagged
      GROUP BY doc_id) told""",
    "p_date_bucket": """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, round(avg(value), 6) AS mean
FROM events GROUP BY date_trunc('day', ts), event_type""",
}


def over_files(sql: str, folder: str) -> str:
    """Point the table names after FROM and JOIN at the Parquet files of a folder."""
    names = "|".join(TABLES)
    return re.sub(
        rf"\b(FROM|JOIN) ({names})\b",
        lambda found: f"{found[1]} parquet.`{table_path(folder, found[2])}` AS {found[2]}",
        sql,
    )


def _forwarded(sql: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, over_files(sql, folder))

    return run


def p_date_bucket(spark: SparkSession, folder: str) -> DataFrame:
    days = query(spark, over_files(FORWARDED["p_date_bucket"], folder))
    return days.withColumn("day", F.col("day").cast("timestamp_ntz"))


def p_correlated(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a quantity above 1.5 times the average of their part."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    averages = lines.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"))
    large = lines.join(averages, "l_partkey").where(F.col("l_quantity") > 1.5 * F.col("mean"))
    return large.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


def p_asof_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the latest click of its user at or before it."""
    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    purchases = events.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id", "value")
    clicks = events.where(F.col("event_type") == "click").select("user_id", "ts", "event_id", "value")
    matched = last_before(purchases, clicks, ["user_id"], "ts", "event_id", "click")
    return matched.select(
        "event_id", "user_id", "ts", "value",
        F.col("click.event_id").alias("click_id"),
        F.col("click.ts").alias("click_ts"),
        F.col("click.value").alias("click_value"),
    )


def p_window_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Running total and previous event of each user, by time."""
    events = read_table(spark, folder, "events").select(
        "user_id", "ts", "event_id", "value", F.struct("event_type", "value").alias("here")
    )
    scanned = ordered_scan(
        events, ["user_id"], ["ts", "event_id"], sums={"running": "value"}, lasts={"back": ("here", 1)}
    )
    return scanned.select(
        "event_id", "user_id",
        F.round("running", 2).alias("running"),
        F.col("back.event_type").alias("previous_type"),
        F.col("back.value").alias("previous_value"),
    )


QUERIES = {name: _forwarded(sql) for name, sql in FORWARDED.items()} | {
    "p_date_bucket": p_date_bucket,
    "p_correlated": p_correlated,
    "p_asof_join": p_asof_join,
    "p_window_frame": p_window_frame,
}

CHECKS = {
    **FORWARDED,
    "p_semi_anti": """
SELECT 'with' AS kind, c_mktsegment, count(*) AS customers
FROM customer SEMI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) big
  ON o_custkey = c_custkey GROUP BY c_mktsegment
UNION ALL
SELECT 'without' AS kind, c_mktsegment, count(*) AS customers
FROM customer ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) big
  ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "p_setops": """
SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a
UNION ALL
SELECT 'unlabelled' AS kind, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b
UNION ALL
SELECT 'any' AS kind, doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) c""",
    "p_join_multiway": FORWARDED["p_join_multiway"].replace("sum(orders)", "sum(orders)::BIGINT"),
    "p_date_bucket": FORWARDED["p_date_bucket"].replace("SELECT date_trunc('day', ts)", "SELECT date_trunc('day', ts)::TIMESTAMP"),
    "p_correlated": """
SELECT l_partkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem l
WHERE l_quantity > 1.5 * (SELECT avg(l_quantity) FROM lineitem a WHERE a.l_partkey = l.l_partkey)
GROUP BY l_partkey""",
    "p_asof_join": """
SELECT p.event_id, p.user_id, p.ts, p.value, c.event_id AS click_id, c.ts AS click_ts, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.ts <= p.ts
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) = 1""",
    "p_window_frame": """
SELECT event_id, user_id,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value
FROM events""",
}

"""Joins on intervals of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.intervals import micros, overlaps, totals_within
from lakeseed.sources.tables import read_table


def interval_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Every signup opens a window of ``value`` minutes; the errors of any user within it are counted."""
    events = read_table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    at = micros("ts").alias("start")
    signups = events.where("event_type = 'signup'").select("event_id", at, (at + F.floor(F.col("value") * 60) * 1_000_000).alias("end"))
    errors = events.where("event_type = 'error'").select("value", at)
    found = totals_within(signups, errors, ("start", "end"), "start", "value")
    met = signups.join(found, ["start", "end"])
    counts = met.groupBy("event_id").agg(F.sum("points").alias("errors"), F.round(F.sum("total"), 2).alias("total"))
    return signups.select("event_id").join(counts, "event_id", "left").fillna(0, ["errors"])


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer that are open at the same time: from the order's date to its last shipment."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("start"))
    lines = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(micros(F.max("l_shipdate")).alias("end"))
    spans = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")
    met = overlaps(spans, spans, ("start", "end"), ("start", "end"), ["o_custkey"]).where("l.o_orderkey < r.o_orderkey")
    shared = (F.least("l.end", "r.end") - F.greatest("l.start", "r.start")) / F.lit(86_400_000_000)
    return met.groupBy(F.col("l.o_custkey").alias("o_custkey")).agg(
        F.count("*").alias("pairs"), F.sum(shared.cast("long")).alias("days"), F.count_distinct("l.o_orderkey").alias("orders")
    )


QUERIES = {"interval_contains": interval_contains, "interval_overlap": interval_overlap}

CHECKS = {
    "interval_contains": """
SELECT s.event_id, count(e.event_id) AS errors, round(sum(e.value), 2) AS total
FROM (SELECT event_id, ts, ts + to_seconds(floor(value * 60)::BIGINT) AS until FROM events WHERE event_type = 'signup') s
LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.ts >= s.ts AND e.ts < s.until
GROUP BY s.event_id""",
    "interval_overlap": """
WITH spans AS (
  SELECT o_orderkey, o_custkey, o_orderdate AS began, max(l_shipdate) AS ended
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_shipdate) > o_orderdate)
SELECT a.o_custkey, count(*) AS pairs, count(DISTINCT a.o_orderkey) AS orders,
       sum(date_diff('day', greatest(a.began, b.began), least(a.ended, b.ended)))::BIGINT AS days
FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
                         AND a.began < b.ended AND b.began < a.ended
GROUP BY a.o_custkey""",
}

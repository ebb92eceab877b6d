"""Ranks and frames over hot keys, mergeable sketches, paged results and sharded logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.ranking import framed, ranked, tiled, with_next
from lakeseed.operators.sketches import distinct_count, distinct_states, quantile_states, quantiles
from lakeseed.plans.catalog import query
from lakeseed.plans.pages import paged
from lakeseed.plans.queries.surface import over_files
from lakeseed.sources.files import read_logs
from lakeseed.sources.log import append, read_log
from lakeseed.sources.tables import read_table
from lakeseed.streaming.timed import job
from lakeseed.workspace import new_folder, new_path, stored

HOUR = 3_600_000_000
SHARDS = 4


def rank_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's place among those of its type by value, largest first: five keys hold all rows."""
    events = read_table(spark, folder, "events").select("event_id", "event_type", (-F.col("value")).alias("less"))
    placed = ranked(events, ["event_type"], "less").select("event_id", "event_type", "less", "rank", "dense_rank", "total")
    return tiled(placed, ["event_type"], ["less", "event_id"], 10).drop("less", "row_number")


def range_frame(spark: SparkSession, folder: str) -> DataFrame:
    """How many events of its type the hour up to each event holds, and their value."""
    events = read_table(spark, folder, "events").select(
        "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("value").cast("decimal(18,2)").alias("value"), F.lit(1).cast("long").alias("one"),
    )
    found = framed(events, ["event_type"], "at", "event_id", HOUR, {"events": "one", "total": "value"})
    return found.select("event_id", "events", F.col("total").cast("double").alias("total"))


def next_event(spark: SparkSession, folder: str) -> DataFrame:
    """The type of the event that the same user has next."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    order = {"at": F.unix_micros(F.col("ts").cast("timestamp")), "id": F.col("event_id")}
    return with_next(events, ["user_id"], order, "event_type", "next_type").select("event_id", "next_type")


def sketch_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Users by day and type, stored as sketches, merged by type: off by less than 5 %."""
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    states = stored(distinct_states(events, ["day", "event_type"], "user_id", "users"), "sketches")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")
    return distinct_count(states, ["event_type"], "users").join(exact, "event_type").select("event_type", "exact", near.alias("is_near"))


def sketch_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the value from stored daily sketches: their true shares are off by less than 0.04."""
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    states = stored(quantile_states(events, ["day", "event_type"], "value", "values"), "sketches")
    found = stored(quantiles(states, ["event_type"], "values", [0.1, 0.5, 0.9]), "quantiles")
    # Three numbers for each type: events are compared with them by type.
    below = F.avg((events["value"] <= found["value"]).cast("double"))
    true = events.join(found, "event_type").groupBy("event_type", "share").agg(below.alias("below"))
    return true.select("event_type", "share", (F.abs(F.col("below") - F.col("share")) < 0.04).alias("is_near"))


ORDERS = """
SELECT c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O'"""


def paged_result(spark: SparkSession, folder: str) -> DataFrame:
    """A forwarded query's rows with the page of 1,000 each stands on."""
    pages = paged(query(spark, over_files(ORDERS, folder)), ["c_mktsegment", "o_orderkey"])
    return pages.all(spark)


def _logged(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    return new_folder(spark, "log"), read_table(spark, folder, "events")


def log_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a log in two goes, read by shard."""
    path, events = _logged(spark, folder)
    for half in (0, 1):
        append(events.where(F.col("event_id") % 2 == half), path, "user_id", SHARDS)
    records = read_log(spark, path, events.schema, SHARDS)
    return records.groupBy("shard").agg(
        F.count("*").alias("events"), F.max("number").alias("last"), F.round(F.sum("value"), 2).alias("total")
    )


def log_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A stream reads a log, stops, and goes on where it was when more has been appended."""
    path, events = _logged(spark, folder)
    out = None
    for part in range(3):
        append(events.where(F.col("event_id") % 3 == part), path, "user_id", SHARDS)
        records = read_log(spark, path, events.schema, SHARDS, streaming=True)
        out = out or job(records, "resumed")
        out.append(records)
    rows = out.rows(spark)
    return rows.groupBy("shard").agg(
        F.count("*").alias("events"), F.count_distinct("number").alias("numbers"), F.round(F.sum("value"), 2).alias("total")
    )


def log_follow(spark: SparkSession, folder: str) -> DataFrame:
    """Line logs of two services, followed as one stream while they grow."""
    events = read_table(spark, folder, "events")
    lines = F.concat_ws(" ", "event_id", "user_id", "event_type")
    paths = {name: new_path(spark, f"log-{name}") for name in ("billing", "web")}
    out = None
    for half in (0, 1):
        rows = events.where(F.col("event_id") % 2 == half)
        rows.where("event_type = 'purchase'").select(lines.alias("value")).write.mode("append").text(paths["billing"])
        rows.where("event_type <> 'purchase'").select(lines.alias("value")).write.mode("append").text(paths["web"])
        followed = read_logs(spark, paths, streaming=True)
        out = out or job(followed, "followed")
        out.append(followed)
    return out.rows(spark).groupBy("service").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


QUERIES = {
    "rank_events": rank_events,
    "range_frame": range_frame,
    "next_event": next_event,
    "sketch_distinct": sketch_distinct,
    "sketch_quantiles": sketch_quantiles,
    "paged_result": paged_result,
    "log_batch": log_batch,
    "log_resume": log_resume,
    "log_follow": log_follow,
}

CHECKS = {
    "rank_events": """
SELECT event_id, event_type, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, count(*) OVER (PARTITION BY event_type) AS total,
       ntile(10) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS tile
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC)""",
    "range_frame": """
SELECT event_id, count(*) OVER w AS events, (sum(value::DECIMAL(18,2)) OVER w)::DOUBLE AS total FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
    "next_event": """
SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events""",
    "sketch_distinct": """
SELECT event_type, count(DISTINCT user_id) AS exact, true AS is_near FROM events GROUP BY event_type""",
    "sketch_quantiles": """
SELECT event_type, share::DOUBLE AS share, true AS is_near
FROM (SELECT DISTINCT event_type FROM events), (VALUES (0.1), (0.5), (0.9)) t(share)""",
    "paged_result": f"""
SELECT *, row_number() OVER (ORDER BY c_mktsegment, o_orderkey) - 1 AS row,
       (row_number() OVER (ORDER BY c_mktsegment, o_orderkey) - 1) // 1000 AS page FROM ({ORDERS})""",
    "log_batch": """
SELECT user_id % 4 AS shard, count(*) AS events, count(*) - 1 AS last, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "log_resume": """
SELECT user_id % 4 AS shard, count(*) AS events, count(*) AS numbers, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "log_follow": """
SELECT CASE event_type WHEN 'purchase' THEN 'billing' ELSE 'web' END AS service, count(*) AS lines,
       sum(length(event_id || ' ' || user_id || ' ' || event_type))::BIGINT AS chars FROM events GROUP BY 1""",
}

"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.sources.tables import read_table, table_path
from lakeseed.streaming.messages import first_error as find_first_error
from lakeseed.streaming.streams import Route, Stream, fan_out, open_files, shard_events, tumbling

ROUTES = [
    Route("app", "click", "clicks"),
    Route("app", "purchase", "billing"),
    Route("app", "purchase", "audit"),
    Route("app", "signup", "audit"),
    Route("ops", "error", "alerts"),
    Route("ops", "click", "never"),
]


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "events").schema
    return open_files(spark, table_path(folder, "events"), schema)


def stream_shards(spark: SparkSession, folder: str) -> DataFrame:
    written = shard_events(_event_stream(spark, folder), Stream("events", 4), "user_id")
    return written.groupBy("shard").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


def stream_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Errors arrive on their own bus; views have no route and one route never matches."""
    bus = F.when(F.col("event_type") == "error", "ops").otherwise("app")
    rows = _event_stream(spark, folder).withColumn("bus", bus)
    delivered = fan_out(rows, ROUTES, "bus", "event_type")
    return delivered.groupBy("queue").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


def message_body() -> Column:
    """An event as a message: errors and signups fail in two ways, clicks are cut off."""
    return (
        F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("props").alias("error"))))
        .when(
            F.col("event_type") == "signup",
            F.to_json(F.struct(F.lit("").alias("error"), F.struct(F.col("props").alias("message")).alias("errorDetail"))),
        )
        .when(F.col("event_type") == "click", F.regexp_replace("props", r"\}$", ""))
        .otherwise(F.col("props"))
    )


def first_error(spark: SparkSession, folder: str) -> DataFrame:
    """Each user is a stream of messages."""
    messages = read_table(spark, folder, "events").select("user_id", "event_id", message_body().alias("body"))
    return find_first_error(messages, "user_id", "event_id", "body")


def p_stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = tumbling(
        rows, "ts", "1 day", "1 hour",
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"),
    )
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    "stream_shards": stream_shards,
    "stream_fanout": stream_fanout,
    "first_error": first_error,
    "p_stream_tumbling": p_stream_tumbling,
}

CHECKS = {
    "stream_shards": """
SELECT (user_id % 4)::INT AS shard, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "stream_fanout": """
SELECT queue, count(*) AS events, round(sum(value), 2) AS total
FROM events JOIN (VALUES ('click', 'clicks'), ('purchase', 'billing'), ('purchase', 'audit'),
                         ('signup', 'audit'), ('error', 'alerts')) routes(topic, queue) ON topic = event_type
GROUP BY 1""",
    "first_error": """
SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'malformed message: ' || regexp_replace(props, '\\}$', '')
                                          ELSE props END AS message
FROM events WHERE event_type IN ('error', 'signup', 'click')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "p_stream_tumbling": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS events, round(sum(value), 2) AS total
FROM events GROUP BY 1""",
}

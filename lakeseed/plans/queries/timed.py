"""Streams by event time over the events table, which arrives in parts: some rows come later than they should."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.plans.queries.streams import message_body
from lakeseed.sources.tables import read_table
from lakeseed.streaming.state import expired, first_error_stream
from lakeseed.streaming.streams import open_files
from lakeseed.streaming.timed import Split, follows, job, sessions, sliding, split_late
from lakeseed.workspace import new_path

PARTS, LATE, GAP, GAP_MS, WITHIN = 3, "1 day", "6 hours", 6 * 3_600_000, "2 hours"


def _arrivals(spark: SparkSession, folder: str, delays: bool) -> Iterator[DataFrame]:
    """The events as a stream that has one part more each time it is given: ten days, and what was delayed."""
    events = read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.floor((F.dayofmonth("ts") - 1) / 10)
    if delays:
        part = part + F.when(F.col("event_id") % 50 == 3, 2).when(F.col("event_id") % 10 == 7, 1).otherwise(0)
    events = events.withColumn("part", F.least(part, F.lit(PARTS - 1)))
    path = new_path(spark, "arrivals")
    for n in range(PARTS):
        arrived = events.where(F.col("part") == n).drop("part")
        arrived.write.mode("append").parquet(path)
        yield open_files(spark, path, arrived.schema)


def _split(spark: SparkSession, folder: str) -> Split:
    split = None
    for rows in _arrivals(spark, folder, delays=True):
        split = split or split_late(rows, "ts", LATE)
        split.add(rows)
    return split


def _run(spark: SparkSession, folder: str, label: str, made) -> DataFrame:
    """What a stream made of the events gives in all, run anew after each part."""
    out = None
    for rows in _arrivals(spark, folder, delays=False):
        stream = made(rows)
        out = out or job(stream, label)
        out.append(stream)
    return out.rows(spark)


def _times(rows: DataFrame) -> DataFrame:
    names = [field.name for field in rows.schema if field.dataType.typeName() == "timestamp"]
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in names})


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    late = _split(spark, folder).late_rows(spark)
    return late.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))


def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    in_time = _split(spark, folder).in_time(spark)
    found = sessions(in_time, ["user_id"], "ts", GAP, LATE, F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    out = job(found, "sessions")
    out.append(found)
    return _times(out.rows(spark))


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    aggregates = (F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return _times(_run(spark, folder, "sliding", lambda rows: sliding(rows, ["event_type"], "ts", "2 days", "1 day", LATE, *aggregates)))


def stream_first_error(spark: SparkSession, folder: str) -> DataFrame:
    """Each user is an open stream of messages that stops at its first error."""
    return _run(
        spark, folder, "errors",
        lambda rows: first_error_stream(rows.select("user_id", "event_id", message_body().alias("body")), "user_id", "event_id", "body"),
    )


def key_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Each event puts its type under its user; a key lives six hours after its last put."""
    in_time = _split(spark, folder).in_time(spark)
    over = expired(in_time, "user_id", "event_type", "ts", "event_id", GAP_MS, LATE)
    out = job(over, "expired")
    out.append(over)
    return out.rows(spark)


def _clicks_and_purchases(rows: DataFrame, how: str) -> DataFrame:
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return follows(clicks, bought, ["user_id"], "click_ts", "purchase_ts", WITHIN, LATE, how)


def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    return _times(_run(spark, folder, "pairs", lambda rows: _clicks_and_purchases(rows, "inner")))


def stream_join_left(spark: SparkSession, folder: str) -> DataFrame:
    return _times(_run(spark, folder, "pairs", lambda rows: _clicks_and_purchases(rows, "left")))


QUERIES = {
    "late_events": late_events,
    "session_windows": session_windows,
    "sliding_windows": sliding_windows,
    "stream_first_error": stream_first_error,
    "key_expiry": key_expiry,
    "stream_join": stream_join,
    "stream_join_left": stream_join_left,
}

_ARRIVED = """
arrived AS (
  SELECT *, least(2, (day(ts) - 1) // 10 + CASE WHEN event_id % 50 = 3 THEN 2 WHEN event_id % 10 = 7 THEN 1 ELSE 0 END) AS part
  FROM events),
limits AS (
  SELECT p.part, (SELECT max(ts) FROM arrived a WHERE a.part < p.part) - INTERVAL 1 DAY AS bound
  FROM (SELECT DISTINCT part FROM arrived) p),
judged AS (SELECT a.*, coalesce(ts < bound, false) AS is_late FROM arrived a JOIN limits USING (part)),
in_time AS (SELECT * FROM judged WHERE NOT is_late),
sealed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS bound FROM in_time),
begun AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS is_first
  FROM in_time),
numbered AS (SELECT *, sum(is_first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM begun)"""

_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"

_PAIRS = """
SELECT c.user_id, c.event_id AS click_id, c.ts AS click_ts, p.event_id AS purchase_id, p.ts AS purchase_ts
FROM (SELECT * FROM events WHERE event_type = 'click') c
JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
  ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR"""

CHECKS = {
    "late_events": f"""
WITH {_ARRIVED}
SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM judged WHERE is_late GROUP BY event_type""",
    "session_windows": f"""
WITH {_ARRIVED}
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events,
       round(sum(value), 2) AS total
FROM numbered GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT bound FROM sealed)""",
    "sliding_windows": f"""
WITH spans AS (
  SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL (n) DAY AS window_start, event_type, value
  FROM events, (VALUES (0), (1)) t(n))
SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, event_type, count(*) AS events, round(sum(value), 2) AS total
FROM spans WHERE window_start + INTERVAL 2 DAY <= {_CLOSED} GROUP BY ALL""",
    "stream_first_error": """
SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'malformed message: ' || regexp_replace(props, '\\}$', '')
                                          ELSE props END AS message
FROM events WHERE event_type IN ('error', 'signup', 'click')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "key_expiry": f"""
WITH {_ARRIVED}
SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, epoch_us(max(ts)) // 1000 + 21600000 AS expired_ms,
       count(*) AS puts, arg_max(event_type, event_id) AS value
FROM numbered GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT bound FROM sealed)""",
    "stream_join": _PAIRS,
    "stream_join_left": f"""
WITH pairs AS ({_PAIRS}),
closed AS (
  SELECT date_trunc('milliseconds', min(latest)) - INTERVAL 1 DAY AS bound
  FROM (SELECT max(ts) AS latest FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type))
SELECT * FROM pairs
UNION ALL
SELECT user_id, event_id, ts, NULL, NULL FROM events
WHERE event_type = 'click' AND event_id NOT IN (SELECT click_id FROM pairs) AND ts + INTERVAL 2 HOUR < (SELECT bound FROM closed)""",
}

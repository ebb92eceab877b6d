"""Streams give the batch result; messages report their first error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeseed.streaming.messages import first_error
from lakeseed.streaming.streams import Route, Stream, fan_out, open_files, shard_events, tumbling
from lakeseed.workspace import new_path


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "events")
    rows = spark.range(0, 1000, 1, 5).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("user"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("topic"),
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
    )
    rows.write.parquet(path)
    return path


def stream(spark, path, per_batch=2):
    return open_files(spark, path, spark.read.parquet(path).schema, per_batch)


def test_shards(spark, folder):
    assert Stream("s", 0).shards == 1 and Stream("s", -3).shards == 1
    with pytest.raises(ValueError):
        Stream("")
    written = shard_events(stream(spark, folder), Stream("s", 4), "user")
    batch = spark.read.parquet(folder).withColumn("shard", F.pmod("user", F.lit(4)).cast("int"))
    key = ["shard", "id", "user", "topic"]
    assert sorted(map(tuple, written.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_fan_out_delivers_by_route_only(spark, folder):
    routes = [Route("x", "a", "q1"), Route("x", "a", "q2"), Route("x", "b", "q2"), Route("y", "c", "q3"), Route("x", "a", "q1")]
    delivered = fan_out(stream(spark, folder).withColumn("bus", F.lit("x")), routes, "bus", "topic")
    counts = {row["queue"]: row["count"] for row in delivered.groupBy("queue").count().collect()}
    assert counts == {"q1": 334, "q2": 667}


def test_streams_without_rows(spark):
    path = new_path(spark, "events")
    spark.createDataFrame([], "user long, topic string, ts timestamp").write.parquet(path)
    assert shard_events(stream(spark, path), Stream("s", 4), "user").count() == 0
    routed = fan_out(stream(spark, path).withColumn("bus", F.lit("x")), [Route("x", "a", "q")], "bus", "topic")
    assert routed.count() == 0 and "queue" in routed.columns
    assert tumbling(stream(spark, path), "ts", "1 day", "1 hour", F.count(F.lit(1)).alias("n")).count() == 0


def test_queue_names_stay_text(spark, folder):
    routes = [Route("x", "a", "007")]
    delivered = fan_out(stream(spark, folder).withColumn("bus", F.lit("x")), routes, "bus", "topic")
    assert delivered.select("queue").distinct().collect()[0]["queue"] == "007"


def test_tumbling_over_several_batches_equals_batch(spark, folder):
    got = tumbling(stream(spark, folder), "ts", "1 day", "1 hour", F.count(F.lit(1)).alias("n"))
    want = spark.read.parquet(folder).groupBy(F.window("ts", "1 day").start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.select("window_start", "n").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_windows_updated(spark):
    path = new_path(spark, "events")
    hours = [[0, 1, 30], [2, 31], [1, 240], [241], [200]]
    for number, batch in enumerate(hours):
        rows = spark.createDataFrame([(h,) for h in batch], "h int").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(path)
    got = tumbling(stream(spark, path, 1), "ts", "1 day", "1 hour", F.count(F.lit(1)).alias("n"))
    found = {int(row["window_start"].timestamp()) // 86400: row["n"] for row in got.collect()}
    # A batch is judged by the watermark that held before the previous one.
    assert found == {0: 3, 1: 2, 10: 2}


def test_first_error(spark):
    rows = [
        ("space", 1, "\n \t"), ("twice", 1, '{"error":"","error":"y"}'), ("empty", 1, '{"error":"x","error":""}'),
        ("ok", 1, '{"status":"x"}'), ("ok", 2, '{"error":"","errorDetail":{"message":""}}'),
        ("err", 1, '{"status":"x"}'), ("err", 2, '{"error":"first"}'), ("err", 3, '{"error":"second"}'),
        ("detail", 5, '{"errorDetail":{"message":"inner"}}'),
        ("both", 1, '{"error":"outer","errorDetail":{"message":"inner"}}'),
        ("bad", 1, '{"status":'), ("bad", 2, '{"error":"later"}'),
        ("blank", 1, ""), ("none", 1, None),
        ("number", 1, "5"), ("list", 1, '[{"error":"x"}]'), ("null", 1, " null "),
        ("kind", 1, '{"error":5}'), ("kind2", 1, '{"errorDetail":"x"}'), ("kind3", 1, '{"errorDetail":{"message":1}}'),
        ("nulls", 1, '{"error":null,"errorDetail":null,"status":null}'), ("status", 1, '{"status":1,"error":"e"}'),
    ]
    messages = spark.createDataFrame(rows, "stream string, seq int, body string").repartition(4)
    got = {row["stream"]: (row["seq"], row["message"]) for row in first_error(messages, "stream", "seq", "body").collect()}
    assert got == {
        "err": (2, "first"), "detail": (5, "inner"), "both": (1, "outer"),
        "bad": (1, 'malformed message: {"status":'), "number": (1, "malformed message: 5"),
        "list": (1, 'malformed message: [{"error":"x"}]'), "kind": (1, 'malformed message: {"error":5}'),
        "kind2": (1, 'malformed message: {"errorDetail":"x"}'),
        "kind3": (1, 'malformed message: {"errorDetail":{"message":1}}'),
        "twice": (1, "y"),
        "status": (1, 'malformed message: {"status":1,"error":"e"}'),
    }

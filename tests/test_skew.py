"""Joins and ordered scans with one key that holds a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lakeseed.operators.keyed import lookup
from lakeseed.operators.skew import last_before, ordered_scan, split_by_order


@pytest.fixture(scope="module")
def facts(spark):
    draw = random.Random(3)
    rows = []
    for i in range(6000):
        key = 7 if i % 3 == 0 else draw.randrange(500)
        rows.append((i, None if i % 50 == 49 else key, draw.randrange(1000), float(draw.randrange(100))))
    return spark.createDataFrame(rows, "id long, key long, at long, x double").repartition(6).cache()


@pytest.fixture()
def many_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_adaptive_execution_spreads_a_hot_key(spark):
    """Plain joins are left to adaptive execution, which splits the hot key where nothing is broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    kept = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        probes = spark.range(0, 90_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("x")
        )
        pairs = spark.range(500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        joined = lookup(probes, pairs, "key").groupBy(F.spark_partition_id().alias("p"))
        sizes = joined.agg(F.count(F.lit(1)).alias("count"), F.max("x")).collect()
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sum(row["count"] for row in sizes) == 90_000
    assert max(row["count"] for row in sizes) < 15_000


def test_exact_copies_are_spread(spark, many_partitions):
    copies = spark.range(0, 6000, 1, 12).select(F.lit(7).alias("key"), F.lit(1).alias("id"), F.lit(2.0).alias("x"))
    split = split_by_order(copies, ["key"], ["id"])
    assert split.select("_part").distinct().count() >= 6
    total = ordered_scan(copies, ["key"], ["id"], {"total": "x"}, {})
    assert sorted(row["total"] for row in total.collect()) == [2.0 * n for n in range(1, 6001)]


def test_parts_are_shuffled_once(spark, facts):
    """The written buckets serve the windows; only summaries are shuffled after that."""
    scanned = ordered_scan(facts, ["key"], ["at", "id"], sums={"total": "x"})
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [sum(x"):]
    assert "Exchange" not in window[: window.index("FileScan")]


def brute(rows):
    order = sorted(rows, key=lambda r: (r["key"] is not None, r["key"] or 0, r["at"], r["id"]))
    total, back, last_key, out = 0.0, None, object(), {}
    for row in order:
        if row["key"] != last_key:
            total, back, last_key = 0.0, None, row["key"]
        total += row["x"]
        out[row["id"]] = (total, back)
        back = row["x"]
    return out


def test_ordered_scan_across_partitions(facts, many_partitions):
    split = split_by_order(facts.withColumn("here", F.struct("x")), ["key"], ["at", "id"])
    sizes = {row["_part"]: row["count"] for row in split.groupBy("_part").count().collect()}
    assert len(sizes) == 16
    assert max(sizes.values()) < 1000
    assert split.where("key = 7").select("_part").distinct().count() > 3
    wanted = ({"total": "x"}, {"back": ("here", 1)})
    scanned = ordered_scan(facts.withColumn("here", F.struct("x")), ["key"], ["at", "id"], *wanted)
    got = {row["id"]: (row["total"], row["back"] and row["back"]["x"]) for row in scanned.collect()}
    assert got == brute(facts.collect())


def test_running_sum_of_nulls_is_null(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 2.0)], "key int, at int, x double")
    scanned = ordered_scan(rows, ["key"], ["at"], sums={"total": "x"})
    assert [row["total"] for row in scanned.orderBy("at").collect()] == [None, None, 2.0]


def test_last_before_equals_brute_force(facts, many_partitions):
    builds = facts.where("id % 2 = 0").select("key", "at", "id", "x")
    probes = facts.where("id % 2 = 1").select("key", "at", "id", F.col("x").alias("y"))
    got = {row["id"]: row["hit"] and row["hit"]["id"] for row in last_before(probes, builds, ["key"], "at", "id", "hit").collect()}
    by_key = {}
    for row in builds.collect():
        by_key.setdefault(row["key"], []).append((row["at"], row["id"]))
    want = {}
    for row in probes.collect():
        earlier = [] if row["key"] is None else [b for b in by_key.get(row["key"], []) if b[0] <= row["at"]]
        want[row["id"]] = max(earlier)[1] if earlier else None
    assert got == want


def test_rows_without_a_time_match_nothing(spark):
    schema = "key int, at int, id int"
    builds = spark.createDataFrame([(1, None, 9), (2, 5, 8)], schema)
    probes = spark.createDataFrame([(1, 3, 1), (1, None, 2), (2, None, 3), (2, 6, 4)], schema)
    found = last_before(probes, builds, ["key"], "at", "id", "hit").collect()
    assert {row["id"]: row["hit"] and row["hit"]["id"] for row in found} == {1: None, 2: None, 3: None, 4: 8}

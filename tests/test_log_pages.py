"""Sharded logs are read once whatever stops; pages together are the result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeseed.operators.sketches import distinct_count, distinct_states, quantile_states, quantiles
from lakeseed.plans.pages import next_page, paged
from lakeseed.sources.log import append, read_log, shard_path
from lakeseed.streaming.timed import job
from lakeseed.workspace import new_folder

SCHEMA = "id long, text string"


def made(spark, low, high):
    return spark.range(low, high).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))


def test_records_are_numbered_without_gaps(spark):
    path = new_folder(spark, "log")
    schema = made(spark, 0, 1).schema
    assert read_log(spark, path, schema, 3).count() == 0
    for low, high in ((0, 100), (100, 101), (101, 101), (101, 400)):
        append(made(spark, low, high), path, "id", 3)
    rows = read_log(spark, path, schema, 3)
    assert rows.rdd.getNumPartitions() == 3
    found = rows.collect()
    assert sorted((r.id, r.text) for r in found) == sorted((r.id, r.text) for r in made(spark, 0, 400).collect())
    for shard in range(3):
        mine = sorted((r.number, r.id) for r in found if r.shard == shard)
        assert [n for n, _ in mine] == list(range(len(mine))) and all(i % 3 == shard for _, i in mine)
    # What an earlier append holds comes before what a later one holds.
    assert max(r.number for r in found if r.id < 100 and r.shard == 0) < min(r.number for r in found if r.id > 101 and r.shard == 0)
    with pytest.raises(ValueError):
        append(made(spark, 0, 1), path, "id", 0)


def test_a_stream_goes_on_where_it_stopped(spark):
    path = new_folder(spark, "log")
    schema, out, seen = made(spark, 0, 1).schema, None, []
    for low, high in ((0, 50), (50, 50), (50, 53), (53, 90)):
        append(made(spark, low, high), path, "id", 2)
        rows = read_log(spark, path, schema, 2, streaming=True)
        out = out or job(rows, "log-out")
        out.append(rows)
        out.append(rows)
        seen.append(out.rows(spark).count())
    assert seen == [50, 50, 53, 90]
    batch = read_log(spark, path, schema, 2)
    assert sorted(map(tuple, out.rows(spark).collect())) == sorted(map(tuple, batch.collect()))


def test_unfinished_files_are_no_records(spark):
    path = new_folder(spark, "log")
    append(made(spark, 0, 10), path, "id", 1)
    made(spark, 0, 5).write.parquet(f"{shard_path(path, 0)}/_aside")
    assert read_log(spark, path, made(spark, 0, 1).schema, 1).count() == 10


def test_pages_together_are_the_result(spark):
    rows = made(spark, 0, 95).withColumn("k", F.col("id") % 4).repartition(6)
    pages = paged(rows, ["k"], 10)
    token, got, sizes = pages.token(0), [], []
    while token:
        page, token = next_page(spark, token)
        part = [tuple(r) for r in page.collect()]
        sizes.append(len(part))
        got += part
    assert sizes == [10] * 9 + [5] and pages.last == 9
    assert got == sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[2], r[0]))
    assert all(f"page={3}/" in file for file in pages.read(spark, 3).inputFiles())
    for wrong in (-1, 10):
        with pytest.raises(ValueError):
            pages.read(spark, wrong)


def test_pages_of_nothing_and_of_copies(spark):
    none = paged(made(spark, 0, 0), ["id"], 3)
    assert none.rows == 0 and none.read(spark, 0).count() == 0 and none.token(1) is None
    copies = spark.createDataFrame([(1, None)] * 7, SCHEMA)
    pages = paged(copies, ["id"], 3)
    assert [pages.read(spark, n).count() for n in range(3)] == [3, 3, 1]
    for wrong in (copies.withColumn("page", F.lit(1)), copies.withColumn("row", F.lit(1))):
        with pytest.raises(ValueError):
            paged(wrong, ["id"])
    with pytest.raises(ValueError):
        paged(copies, ["id"], 0)


def test_sketches_merge_like_their_rows(spark):
    rows = spark.range(0, 60_000).select((F.col("id") % 20_000).alias("u"), (F.col("id") % 5).alias("day"), F.lit("x").alias("k"))
    states = distinct_states(rows, ["k", "day"], "u", "n")
    assert abs(distinct_count(states, ["k"], "n").first()["n"] - 20_000) < 1_000
    found = quantiles(quantile_states(rows, ["k", "day"], "u", "q"), ["k"], "q", [0.0, 0.25, 1.0]).collect()
    assert all(abs(r.value / 20_000 - r.share) < 0.03 for r in found)
    with pytest.raises(ValueError):
        quantiles(states, ["k"], "n", [1.5])

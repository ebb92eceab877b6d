"""Ranks, tiles, next rows and frames against plain ones, with one hot key."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeseed.operators.ranking import framed, ranked, tiled, with_next

SCHEMA = "id long, k string, v long, d decimal(10,2)"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    keys = ["hot"] * 6 + ["b", None]
    return [(n, rng.choice(keys), rng.choice([None, 7, 7, 7, *range(12)]), Decimal(rng.randint(-500, 500)) / 100) for n in range(500)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def low(v):
    return float("-inf") if v is None else v


def test_ranks(frame, rows):
    found = {r.id: (r["rank"], r.dense_rank, r.peers, r.total) for r in ranked(frame, ["k"], "v").collect()}
    assert len(found) == len(rows)
    for i, k, v, _ in rows:
        mine = [low(x[2]) for x in rows if x[1] == k]
        below = [x for x in mine if x < low(v)]
        assert found[i] == (len(below) + 1, len(set(below)) + 1, mine.count(low(v)), len(mine))


@pytest.mark.parametrize("tiles", [1, 3, 7, 1000])
def test_tiles(frame, rows, tiles):
    found = {r.id: (r.row_number, r.tile) for r in tiled(frame, ["k"], ["v", "id"], tiles).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (low(r[2]), r[0]))
        size, more = divmod(len(mine), tiles)
        want = [t + 1 for t in range(tiles) for _ in range(size + (t < more))]
        assert [found[r[0]] for r in mine] == list(zip(range(1, len(mine) + 1), want, strict=True))
    with pytest.raises(ValueError):
        tiled(frame, ["k"], ["v"], 0)


def test_next_rows(frame, rows):
    found = {r.id: r.after for r in with_next(frame, ["k"], {"at": F.col("id")}, "v", "after").collect()}
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        assert [found[r[0]] for r in mine] == [*(r[2] for r in mine[1:]), None]


@pytest.mark.parametrize("before, after", [(0, 0), (3, 0), (2, 5)])
def test_frames(frame, rows, before, after):
    with_one = frame.withColumn("one", F.lit(1).cast("long"))
    found = {r.id: (r.n, r.s) for r in framed(with_one, ["k"], "v", "id", before, {"n": "one", "s": "d"}, after).collect()}
    for i, k, v, _ in rows:
        mine = [x for x in rows if v is not None and x[1] == k and x[2] is not None and v - before <= x[2] <= v + after]
        assert found[i] == ((len(mine), sum(x[3] for x in mine)) if v is not None else (None, None))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranked(empty, ["k"], "v").count() == 0 and tiled(empty, ["k"], ["v"], 3).count() == 0
    assert framed(empty, ["k"], "v", "id", 1, {"s": "d"}).count() == 0

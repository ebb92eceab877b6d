"""Interval joins against all pairs, and their plans."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lakeseed.operators import intervals
from lakeseed.operators.intervals import overlaps, totals_within
from lakeseed.plans.queries.intervals import interval_contains

SCHEMA = "id long, k string, start long, end long"


def plain(left, right, keyed):
    return Counter(
        (a[0], b[0])
        for a in left for b in right
        if None not in (*a[2:], *b[2:]) and max(a[2], b[2]) < min(a[3], b[3])
        and (not keyed or (a[1] is not None and a[1] == b[1]))
    )


def joined(spark, left, right, keyed):
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    met = overlaps(*frames, ("start", "end"), ("start", "end"), ["k"] if keyed else None)
    return Counter((row[0], row[1]) for row in met.select("l.id", "r.id").collect())


def made(rng, n, longest, keys="ab"):
    rows = []
    for i in range(n):
        start = rng.randint(-200, 200)
        rows.append((i, rng.choice([*keys, None]), start, start + rng.choice([0, 1, 2, rng.randint(-3, longest)])))
    return rows


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("bin_rows", [10_000, 3])
def test_like_all_pairs(spark, monkeypatch, keyed, bin_rows):
    monkeypatch.setattr(intervals, "BIN_ROWS", bin_rows)
    rng = random.Random(bin_rows + keyed)
    left, right = made(rng, 70, 5), made(rng, 60, 300)
    left += [(100, "a", None, 5), (101, "a", 5, None), (102, None, 0, 9), (103, "a", -(1 << 40), 1 << 41)]
    assert joined(spark, left, right, keyed) == plain(left, right, keyed)


def test_copies_at_one_moment(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN_ROWS", 20)
    left = [(7, "a", 50, 51)] * 300 + [(8, "a", 49, 60)]
    right = [(n, "a", 50 - n, 51 + n) for n in range(5)] + [(9, "a", 51, 52)]
    assert joined(spark, left, right, False) == plain(left, right, False)


def test_bounds(spark):
    right = [(1, "a", 8, 16), (2, "a", 16, 24), (3, "a", 15, 17), (4, "a", 7, 8)]
    points = [(n, "a", n, n + 1) for n in range(5, 26)]
    assert joined(spark, points, right, True) == plain(points, right, True)
    assert joined(spark, right, points, False) == plain(right, points, False)


def test_empty_sides(spark):
    some = [(1, "a", 0, 9)]
    for left, right in (([], some), (some, []), ([], []), ([(1, "a", 3, 3)], some)):
        assert joined(spark, left, right, False) == Counter()


def test_no_plan_forms_all_pairs(spark):
    plan = interval_contains(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_totals_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN_ROWS", 50)
    rng = random.Random(9)
    spans = [(a, a + rng.choice([0, 1, 2, 90, rng.randint(-3, 400)])) for a in (rng.randint(-200, 200) for _ in range(150))]
    spans += [(-(1 << 40), 1 << 41), (None, 5), (5, None), (7, 8), (7, 8)]
    # A third of the points are at one moment; values may be null, not numbers, or far greater than others.
    points = [(7 if n % 3 == 0 else rng.randint(-250, 700), rng.choice([None, 0.25, 1.5, 1e12])) for n in range(600)]
    points += [(690, float("nan")), (None, 1.0), (-240, float("inf"))]
    frames = spark.createDataFrame(spans, "start long, end long"), spark.createDataFrame(points, "t long, v double").repartition(5)
    seen = []
    monkeypatch.setattr(intervals, "overlaps", lambda *args: seen.append(overlaps(*args)) or seen[-1])
    found = {(r.start, r.end): (r.points, repr(r.total)) for r in totals_within(*frames, ("start", "end"), "t", "v").collect()}
    want = {}
    for a, b in spans:
        inside = [v for t, v in points if None not in (a, b, t) and a <= t < b]
        values = [v for v in inside if v is not None]
        if inside:
            want[a, b] = (len(inside), repr(sum(values)) if values else "None")
    assert found == want and want
    # Each interval meets two blocks of a size at most, however many points it holds.
    assert seen[0].count() <= 20 * len(set(spans)) < sum(n for n, _ in want.values())
    none = totals_within(frames[0].limit(0), frames[1], ("start", "end"), "t", "v")
    assert none.count() == 0 and totals_within(frames[0], frames[1].limit(0), ("start", "end"), "t", "v").count() == 0

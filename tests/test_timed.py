"""Streams by event time that arrive in parts, against plain batch results."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeseed.streaming.messages import first_error
from lakeseed.streaming.state import _Expiring, expired, first_error_stream
from lakeseed.streaming.streams import open_files
from lakeseed.streaming.timed import follows, job, sessions, sliding, split_late
from lakeseed.workspace import new_path

SCHEMA = "k string, ts timestamp, n long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def minutes(time):
    return round((time.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / 60)


class Feed:
    """A folder that grows part by part, and the stream over it."""

    def __init__(self, spark, schema=SCHEMA):
        self.spark, self.schema, self.path = spark, schema, new_path(spark, "feed")
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self.stream()

    def stream(self):
        return open_files(self.spark, self.path, self.spark.read.parquet(self.path).schema)


def test_late_rows_are_kept_aside(spark):
    feed = Feed(spark)
    split = split_late(feed.stream(), "ts", "10 minutes")
    parts = [[("a", at(0), 1), ("a", at(30), 2), ("b", None, 3)], [("a", at(19), 4), ("a", at(20), 5), ("a", at(50), 6)], [], [("b", at(39), 7), ("b", at(40), 8)]]
    for part in parts:
        split.add(feed.add(part))
    split.add(feed.stream())
    assert sorted(r.n for r in split.late_rows(spark).collect()) == [4, 7]
    out = job(split.in_time(spark), "kept")
    out.append(split.in_time(spark))
    assert sorted(r.n for r in out.rows(spark).collect()) == [1, 2, 3, 5, 6, 8]


def test_sessions_merge_over_batches_and_come_out_once(spark):
    feed, out = Feed(spark), None
    parts = [[("a", at(0), 1), ("b", at(2), 1)], [("a", at(4), 1), ("a", at(9), 1)], [("b", at(40), 1), ("a", at(41), 1)], [("c", at(100), 1)]]
    seen = []
    for part in parts:
        rows = sessions(feed.add(part), ["k"], "ts", "5 minutes", "10 minutes", F.count("*").alias("rows"))
        out = out or job(rows, "sessions")
        out.append(rows)
        seen.append(sorted((r.k, minutes(r.session_start), minutes(r.session_end), r.rows) for r in out.rows(spark).collect()))
    # 4 to 9 minutes is a gap of exactly five: the windows touch, and that is one session to Spark or two.
    assert seen[1] == [] and len(seen[-1]) == len(set(seen[-1]))
    assert ("b", 2, 7, 1) in seen[2] and {r[0] for r in seen[-1]} == {"a", "b"}
    assert sum(r[3] for r in seen[-1]) == 6


def test_sliding_windows_hold_each_row_twice(spark):
    feed, out = Feed(spark), None
    for part in ([("a", at(1), 1), ("a", at(14), 2)], [("a", at(90), 4)]):
        rows = sliding(feed.add(part), ["k"], "ts", "20 minutes", "10 minutes", "1 minute", F.sum("n").alias("total"))
        out = out or job(rows, "sliding")
        out.append(rows)
    found = {(minutes(r.window_start), minutes(r.window_end), r.total) for r in out.rows(spark).collect()}
    assert found == {(-10, 10, 1), (0, 20, 3), (10, 30, 2)}


MESSAGES = "s string, seq long, body string"


def test_a_stream_stops_at_its_first_error(spark):
    feed, out, every = Feed(spark, MESSAGES), None, []
    parts = [
        [("x", 1, '{"status": "ok"}'), ("y", 2, '{"error": "bad"}'), ("y", 1, '{"error": "worse"}'), (None, 1, "?")],
        [("x", 2, "{"), ("y", 3, '{"error": "later"}'), ("z", 5, " \n")],
        [("x", 3, '{"error": "late"}'), ("z", 6, '{"errorDetail": {"message": "deep"}}')],
    ]
    for part in parts:
        every += part
        rows = first_error_stream(feed.add(part), "s", "seq", "body")
        out = out or job(rows, "errors")
        out.append(rows)
        batch = first_error(spark.createDataFrame(every, MESSAGES).where("s is not null"), "s", "seq", "body")
        assert sorted(map(tuple, out.rows(spark).collect())) == sorted(map(tuple, batch.collect()))
    assert {r.s: r.seq for r in out.rows(spark).collect()} == {"x": 2, "y": 1, "z": 6}


def test_keys_expire(spark):
    feed, out = Feed(spark), None
    puts = [
        [("a", at(0), 1), ("a", at(3), 2), ("b", at(1), 3), (None, at(1), 4), ("c", None, 5)],
        [("a", at(6), 6), ("a", at(20), 7)],
        [("b", at(50), 8)],
        [("b", at(90), 9)],
    ]
    for part in puts:
        rows = expired(feed.add(part).withColumn("v", F.col("n") * 10), "k", "v", "ts", "n", 5 * 60_000, "10 minutes")
        out = out or job(rows, "expired")
        out.append(rows)
    zero = int(START.timestamp() * 1000)
    found = sorted((r.k, (r.first_ms - zero) // 60_000, (r.expired_ms - zero) // 60_000, r.puts, r.value) for r in out.rows(spark).collect())
    assert found == [("a", 0, 11, 3, "60"), ("a", 20, 25, 1, "70"), ("b", 1, 6, 1, "30"), ("b", 50, 55, 1, "80")]


def test_lifetimes_do_not_depend_on_the_order_of_puts():
    spans = [(t, t, 1, t, str(t)) for t in (0, 3, 9, 12, 30)]
    keeper = _Expiring(5, [])
    want = [(0, 3, 2, 3, "3"), (9, 12, 2, 12, "12"), (30, 30, 1, 30, "30")]
    for order in (spans, spans[::-1], spans[2:] + spans[:2]):
        merged = []
        for span in order:
            merged = keeper._merged([*merged, span])
        assert merged == want
    assert keeper._merged([*want, (6, 6, 1, 6, "6")])[0] == (0, 12, 5, 12, "12")


class _State:
    """A key's state that counts what it is asked for."""

    def __init__(self, now):
        self.now, self.value, self.timers = now, None, []
        self.getCurrentWatermarkMs = lambda: self.now

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.timers.append(at)


def test_a_key_has_one_timer_for_all_its_lifetimes():
    keeper, state = _Expiring(5, ["k", "first_ms", "last_ms", "expired_ms", "puts", "value"]), _State(0)
    times = range(100, 2100, 10)
    rows = pd.DataFrame([(t, t, str(t)) for t in times], columns=["at_ms", "seq", "value"])
    assert list(keeper(("a",), iter([rows[90:], rows[:90]]), state)) == []
    assert state.timers == [104] and len(state.value[0]) == 200
    # The watermark at the very end of a lifetime ends it.
    state.now = 1105
    assert [len(out) for out in keeper(("a",), iter([]), state)] == [101]
    assert state.timers == [104, 1114]
    state.now = 9999
    (rest,) = keeper(("a",), iter([]), state)
    assert rest["first_ms"].tolist() == list(times)[101:] and not state.exists and len(state.timers) == 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_join_of_streams_is_that_of_the_tables(spark, how):
    clicks, bought = Feed(spark, "k string, c timestamp, n long"), Feed(spark, "k string, b timestamp, m long")
    parts = [
        ([("x", at(0), 1), ("y", at(1), 2), (None, at(1), 3)], [("x", at(5), 1)]),
        ([("x", at(20), 4), ("x", at(3), 5)], [("x", at(8), 2), ("y", at(40), 3), (None, at(2), 9)]),
        ([("z", at(100), 6)], [("z", at(100), 4), ("x", at(99), 5)]),
    ]
    out = None
    for left, right in parts:
        rows = follows(clicks.add(left), bought.add(right), ["k"], "c", "b", "10 minutes", "30 minutes", how)
        out = out or job(rows, "pairs")
        out.append(rows)
    found = sorted((r.n, r.m or 0) for r in out.rows(spark).collect())
    pairs = [(1, 1), (1, 2), (5, 1), (5, 2), (6, 4)]
    # A row without a key meets nothing at once; the others when the state of both streams has gone past them.
    alone = [(2, 0), (3, 0), (4, 0)] if how == "left" else []
    assert found == sorted(pairs + alone)
    with pytest.raises(ValueError):
        follows(clicks.stream(), bought.stream(), ["k"], "c", "b", "1 minute", "1 minute", "full")

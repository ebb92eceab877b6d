"""Keyed state: the first failure of an open stream, and keys that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lakeseed.streaming.messages import failures


class _First(StatefulProcessor):
    """Remembers of a key whether a row has come out."""

    def __init__(self, order: str) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "out boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        if not self.done.exists():
            for batch in rows:
                least = batch.nsmallest(1, self.order)
                if len(least) and (best is None or least[self.order].iloc[0] < best[self.order].iloc[0]):
                    best = least
        if best is not None:
            self.done.update((True,))
            yield best

    def close(self) -> None:
        pass


def first_error_stream(messages: DataFrame, stream: str, seq: str, body: str) -> DataFrame:
    """The first error of each stream, as a stream of messages: ``stream, seq, message``.

    A stream stops at its first error: what comes later is dropped and nothing but one mark is kept
    of it. Within a batch the least ``seq`` is first. Messages without an error do not reach
    the state.
    """
    failed = failures(messages, stream, seq, body).where(F.col(stream).isNotNull() & F.col(seq).isNotNull())
    return failed.groupBy(stream).transformWithStateInPandas(
        _First(seq), failed.schema, outputMode="Append", timeMode="None"
    )


SPANS = "first_ms array<long>, last_ms array<long>, puts array<long>, seq array<long>, value array<string>"


class _Expiring:
    """The lifetimes of a key that are still open: from its first put until so long after its last.

    They are a key's one state, which comes with its rows and goes back with what comes out, and its one timer
    waits for the first of them to end: a call to the store for each lifetime takes longer than all else here.
    """

    def __init__(self, ttl_ms: int, columns: list[str]) -> None:
        self.ttl_ms, self.columns = ttl_ms, columns

    def __call__(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in rows:
            new = zip(batch["at_ms"], batch["seq"], batch["value"], strict=True)
            spans = self._merged(spans + [(int(at), int(at), 1, int(seq), value) for at, seq, value in new])
        now = state.getCurrentWatermarkMs()
        over = [span for span in spans if span[1] + self.ttl_ms <= now]
        left = [span for span in spans if span[1] + self.ttl_ms > now]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            # A timer fires when the watermark has passed it; a lifetime ends when the watermark reaches its end.
            state.setTimeoutTimestamp(max(1, min(span[1] for span in left) + self.ttl_ms - 1))
        elif state.exists:
            state.remove()
        if over:
            yield self._frame(key, over)

    def _merged(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for span in sorted(spans, key=lambda s: s[:2]):
            if out and span[0] - out[-1][1] < self.ttl_ms:
                one = out.pop()
                last = max(one, span, key=lambda s: (s[1], s[3]))
                span = (one[0], last[1], one[2] + span[2], last[3], last[4])
            out.append(span)
        return out

    def _frame(self, key, spans: list[tuple]) -> pd.DataFrame:
        rows = [(*key, first, last, last + self.ttl_ms, puts, value) for first, last, puts, _, value in spans]
        return pd.DataFrame(rows, columns=self.columns)


def expired(puts: DataFrame, key: str, value: str, at: str, seq: str, ttl_ms: int, late: str) -> DataFrame:
    """Key/value puts as a stream, with a time to live: each lifetime of a key, when it has expired.

    A put sets the key's value and starts its time anew; a key that is not put again for
    ``ttl_ms`` expires. Rows: the key, ``first_ms``, ``last_ms``, ``expired_ms``, ``puts`` and the last ``value`` (by time, then
    ``seq``). Puts may come in any order within ``late`` of the latest time; older ones are dropped. The
    state holds open lifetimes only, and event-time timers end them. Null keys and times are left out.
    """
    used = puts.select(
        F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq")
    )
    used = used.where("key is not null and at is not null and seq is not null").withWatermark("at", late)
    used = used.withColumn("at_ms", F.unix_millis("at"))
    out = StructType().add(key, used.schema["key"].dataType)
    for name in ("first_ms", "last_ms", "expired_ms", "puts"):
        out = out.add(name, "long")
    out = out.add("value", "string")
    return used.groupBy("key").applyInPandasWithState(
        _Expiring(ttl_ms, out.names), out, SPANS, "append", GroupStateTimeout.EventTimeTimeout
    )

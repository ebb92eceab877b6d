"""Aggregates written in Python, folded inside the tasks before anything is exchanged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: States that a task holds before it passes them on, and bytes of them.
HELD = 100_000
HELD_BYTES = 16 * 1024 * 1024
#: Groups of tasks whose states are merged first, so that no key's states of all tasks meet at once.
MERGE_GROUPS = 64


class Aggregate:
    """A state of bytes for each group: folded from rows, merged in any order, finished once."""

    #: The type of the result.
    returns = "long"

    def fold(self, values: list[pa.Array]) -> bytes:
        """The state of some rows: their columns, as long as each other."""
        raise NotImplementedError

    def merge(self, states: list[bytes]) -> bytes:
        """One state in place of several."""
        raise NotImplementedError

    def finish(self, state: bytes) -> Any:
        """The result of a group."""
        raise NotImplementedError


def aggregated(rows: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, name: str) -> DataFrame:
    """keys and ``name``: the aggregate of each group's rows.

    Every task folds its own rows to one state a group, so a key with a third of all rows is a state
    for each task; the states of groups of tasks are merged, then those of each key. Null keys are a group.
    """
    schema = T.StructType([rows.schema[key] for key in keys] + [T.StructField("_group", T.LongType()), T.StructField("_state", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    whole = rows.select(*keys, *columns, F.spark_partition_id().cast("long").alias("_task"))
    size = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, bytes] = {}
        task = size_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(batch.num_columns - 1)[0].as_py()
            for key, part in _groups(batch, size):
                state = aggregate.fold(part)
                if key in held:
                    size_held -= len(held[key])
                    state = aggregate.merge([held[key], state])
                held[key] = state
                size_held += len(state)
                if size_held >= HELD_BYTES:
                    yield _states(held, task, arrow)
                    held, size_held = {}, 0
            if len(held) >= HELD:
                yield _states(held, task, arrow)
                held, size_held = {}, 0
        yield _states(held, task, arrow)

    @F.arrow_udf("binary")
    def merge(states: pa.Array) -> bytes:
        return aggregate.merge(states.to_pylist())

    @F.arrow_udf(aggregate.returns)
    def finish(states: pa.Array) -> Any:
        return aggregate.finish(aggregate.merge(states.to_pylist()))

    partial = whole.mapInArrow(fold, schema).groupBy(*keys, "_group").agg(merge("_state").alias("_state"))
    return partial.groupBy(*keys).agg(finish("_state").alias(name))


def _groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """The rows of a batch by the values of its first columns."""
    numbers: dict[tuple, int] = {}
    at = np.array([numbers.setdefault(key, len(numbers)) for key in zip(*(batch.column(n).to_pylist() for n in range(size)), strict=True)])
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at))
    placed = batch.take(pa.array(order))
    for key, n in numbers.items():
        start = ends[n - 1] if n else 0
        yield key, [placed.column(c).slice(start, ends[n] - start) for c in range(size, batch.num_columns - 1)]


def _states(held: dict[tuple, bytes], task: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [()] * (len(schema) - 2)
    columns += [[task % MERGE_GROUPS] * len(held), list(held.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class LongestStreak(Aggregate):
    """The longest run of whole numbers that all occur, of numbers from 0 on.

    The state is the first byte of bits that has one, as a number of four bytes, and the bytes of bits from there to the last.
    """

    limit: int = 1 << 20

    def fold(self, values: list[pa.Array]) -> bytes:
        numbers = values[0].drop_null().to_numpy(zero_copy_only=False)
        if not len(numbers):
            return b""
        if not (0 <= numbers.min() and numbers.max() < self.limit):
            raise ValueError(f"numbers must lie from 0 to {self.limit}")
        first = int(numbers.min()) // 8
        bits = np.zeros(int(numbers.max()) + 1 - 8 * first, bool)
        bits[numbers - 8 * first] = True
        return self._state(first, np.packbits(bits, bitorder="little"))

    def merge(self, states: list[bytes]) -> bytes:
        parts = [self._parts(state) for state in states if state]
        if not parts:
            return b""
        first = min(at for at, _ in parts)
        bits = np.zeros(max(at + len(part) for at, part in parts) - first, np.uint8)
        for at, part in parts:
            bits[at - first : at - first + len(part)] |= part
        return self._state(first, bits)

    def finish(self, state: bytes) -> int:
        if not state:
            return 0
        bits = np.unpackbits(self._parts(state)[1], bitorder="little")
        edges = np.flatnonzero(np.diff(np.r_[0, bits, 0]))
        return int((edges[1::2] - edges[::2]).max(initial=0))

    def _state(self, first: int, bits: np.ndarray) -> bytes:
        return first.to_bytes(4, "little") + bits.tobytes()

    def _parts(self, state: bytes) -> tuple[int, np.ndarray]:
        return int.from_bytes(state[:4], "little"), np.frombuffer(state, np.uint8, offset=4)

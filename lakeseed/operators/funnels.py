"""Steps taken in order: a table function over each key's rows, for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.operators.skew import split_by_order


@F.arrow_udtf(returnType="part long, run long, start int, taken long")
class StepsTaken:
    """For every step that a run of rows may start with: how many steps are taken to its end.

    Takes a table partitioned by part and run, in order, with ``_step`` (a row's step, or -1) and ``_steps``, how many there are.
    Batches are read one after another; a run of any length takes no more memory.
    """

    def __init__(self) -> None:
        self.taken: np.ndarray | None = None
        self.name: tuple[int, int] = (0, 0)

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if self.taken is None:
            count = rows.column("_steps")[0].as_py()
            self.start, self.taken = np.arange(count), np.zeros(count, np.int64)
            self.name = (rows.column("_part")[0].as_py(), rows.column("_run")[0].as_py())
        steps = rows.column("_step").to_numpy(zero_copy_only=False)
        count = len(self.start)
        for step in steps[steps >= 0]:
            self.taken += (self.start + self.taken) % count == step
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.taken is not None:
            count = len(self.start)
            yield pa.table({
                "part": pa.array([self.name[0]] * count, pa.int64()), "run": pa.array([self.name[1]] * count, pa.int64()),
                "start": pa.array(self.start, pa.int32()), "taken": pa.array(self.taken, pa.int64()),
            })


def funnels(rows: DataFrame, key: str, order: list[str], step: str, steps: list[str]) -> DataFrame:
    """key, taken, completed: how many steps each key's rows take in order, over and over, and how often all of them.

    A row takes a step if its value is the one that comes next; other rows change nothing. Rows are split by key and order, so a
    key of any size spans many tasks. As a task does not know where earlier rows have got to, it counts
    from every step; the counts of a key's parts, a few numbers each, are put together in order. Null is a key.
    """
    if not steps or len(set(steps)) != len(steps):
        raise ValueError("steps must differ, and there must be one")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, steps)), F.col(step)) - 1, F.lit(-1)).cast("long")
    placed = split_by_order(rows.select(key, *order, number.alias("_step")), [key], order)
    # The keys of a part in their order: a run for each.
    runs = placed.select("_part", key).distinct()
    known = runs.select("_part", F.col(key).alias("_key"), F.xxhash64(key).alias("_run"))
    table = placed.select(
        "_part", F.xxhash64(key).alias("_run"), F.lit(len(steps)).alias("_steps"), "_step", F.col("_part").alias("_by_part"),
        F.xxhash64(key).alias("_by_run"), *(F.col(name).alias(f"_at_{n}") for n, name in enumerate([*order, "_copy"])),
    )
    parted = table.asTable().partitionBy("_by_part", "_by_run").orderBy(*(f"_at_{n}" for n in range(len(order) + 1)))
    counts = StepsTaken(parted).groupBy("part", "run").agg(F.array_sort(F.collect_list(F.struct("start", "taken"))).alias("starts"))
    counts = counts.join(known, (F.col("part") == F.col("_part")) & (F.col("run") == F.col("_run")))
    parts = counts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("part", F.col("starts.taken").alias("taken")))).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda done, part: done + part["taken"][(done % len(steps)).cast("int")])
    found = parts.select(F.col("_key").alias(key), total.alias("taken"))
    return found.withColumn("completed", F.expr(f"taken div {len(steps)}"))

"""Ordered scans and as-of matches that keep one hot key from filling one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lakeseed.workspace import bucketed


def ordered_scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str] | None = None,
    lasts: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Running sums and last seen values of each key, in the given order.

    ``sums`` maps a new column to the column it adds up, this row included. ``lasts``
    maps a new column to ``(column, rows back)``: the last non-null value at least so
    many rows back, 0 or 1. Give a struct column to see nulls inside it.

    Rows are split by key and order whatever their number, so a key of any size spans
    as many tasks as it needs. Each part is scanned by itself; what a key brings in from
    earlier parts comes from one summary row per key and part. Only the first key of a
    part can have started earlier, so fewer rows than parts are carried: small enough to
    broadcast by construction.
    """
    sums, lasts = sums or {}, lasts or {}
    split = split_by_order(rows, keys, order)
    order = [*order, "_copy"]
    summary = [F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()]
    for name, (value, _) in lasts.items():
        present = F.when(F.col(value).isNotNull(), F.struct(*order))
        summary.append(F.max_by(value, present).alias(f"_last_{name}"))
    per_part = split.groupBy(*keys, "_part").agg(F.lit(1).alias("_one"), *summary).drop("_one")

    by_part = Window.partitionBy(*keys).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    incoming = [F.sum(f"_sum_{name}").over(before).alias(f"_in_{name}") for name in sums]
    incoming += [
        F.last(f"_last_{name}", ignorenulls=True).over(before).alias(f"_in_{name}") for name in lasts
    ]
    carried = (
        per_part.select(*keys, "_part", F.lag("_part").over(by_part).alias("_earlier"), *incoming)
        .where(F.col("_earlier").isNotNull())
        .drop("_earlier")
        .withColumnsRenamed({key: f"_key_{key}" for key in keys})
    )

    window = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = split.withColumns(_frames(window, sums, lasts, "_own_"))
    joined = local.join(F.broadcast(carried), "_part", "left")
    # One key per part carries something in; null is a key like any other.
    goes_on = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys])
    brought = {name: F.when(goes_on, F.col(f"_in_{name}")) for name in [*sums, *lasts]}
    own = {name: F.col(f"_own_{name}") for name in [*sums, *lasts]}
    results = {
        name: F.coalesce(brought[name] + own[name], brought[name], own[name]) for name in sums
    }
    results |= {name: F.coalesce(own[name], brought[name]) for name in lasts}
    kept = split.drop("_part", "_copy").columns
    return joined.select(*kept, *[value.alias(name) for name, value in results.items()])


def _frames(window: WindowSpec, sums: dict, lasts: dict, prefix: str) -> dict[str, Column]:
    frames = {
        prefix + name: F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
        for name, value in sums.items()
    }
    for name, (value, back) in lasts.items():
        frame = window.rowsBetween(Window.unboundedPreceding, -back)
        frames[prefix + name] = F.last(value, ignorenulls=True).over(frame)
    return frames


def split_by_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range partition by key and order, so that a hot key spans many parts.

    The part's number is kept in ``_part``. Rows that agree in key and order are told
    apart by their input partition, ``_copy``, so many copies of one row span several
    parts too. Range bounds come from a sample that differs from run to run, so the rows
    are written before the numbers are used twice; a lost executor then costs no second
    sample. They are written in buckets by part: later steps by key and part need no
    second shuffle.
    """
    marked = rows.withColumn("_copy", F.spark_partition_id())
    placed = marked.repartitionByRange(*keys, *order, "_copy").withColumn("_part", F.spark_partition_id())
    return bucketed(placed, "_part", "ordered")


def last_before(
    probes: DataFrame, builds: DataFrame, keys: list[str], at: str, tie: str, name: str
) -> DataFrame:
    """As-of match: each probe row gets the latest build row at or before its time.

    One ordered pass over both inputs instead of a range join, so no pair of rows is
    ever formed. The build row arrives as struct ``name``, null where there is none. Rows
    without a key or a time match nothing.
    """
    build_columns = [column for column in builds.columns if column not in keys]
    probe_columns = [column for column in probes.columns if column not in (*keys, at, tie)]
    probe_struct = F.struct(*probe_columns) if probe_columns else F.struct(F.lit(1).alias("_"))
    left = probes.select(
        *keys, at, tie, F.lit(1).alias("_probe"), probe_struct.alias("_kept")
    )
    right = builds.dropna(subset=[*keys, at]).select(
        *keys, at, tie, F.lit(0).alias("_probe"), F.struct(*build_columns).alias("_build")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    scanned = ordered_scan(both, keys, [at, "_probe", tie], lasts={name: ("_build", 0)})
    # Probes without a time sort before every build row of their key.
    matched = scanned.where(F.col("_probe") == 1)
    kept = [F.col("_kept")[column].alias(column) for column in probe_columns]
    return matched.select(*keys, at, tie, *kept, name)

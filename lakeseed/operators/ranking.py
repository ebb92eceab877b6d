"""Ranks, tiles, next rows and frames by distance, for keys that hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.operators.skew import ordered_scan


def ranked(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows with ``rank``, ``dense_rank``, ``peers`` and ``total``: their place by ascending ``by`` within the keys.

    Counts of equal values are added up before anything is exchanged, so a key or a value with
    any number of rows is a row for each task. The running sums over the values of a key span as many
    tasks as they need. Null is a value, before all others. For descending ranks give a negated column.
    """
    values = rows.groupBy(*keys, by).agg(F.count("*").alias("peers"))
    counted = values.withColumn("_one", F.lit(1).cast("long"))
    scanned = ordered_scan(counted, keys, [by], sums={"_upto": "peers", "dense_rank": "_one"})
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    scanned = scanned.withColumn("rank", F.col("_upto") - F.col("peers") + 1).drop("_upto", "_one")
    places = _same(scanned, totals, keys).select(*keys, by, "rank", "dense_rank", "peers", "total")
    return _same(rows, places, [*keys, by])


def tiled(rows: DataFrame, keys: list[str], order: list[str], tiles: int) -> DataFrame:
    """The rows with ``row_number`` and ``tile``: each key's rows in order, in ``tiles`` parts; earlier ones are longer by one at most."""
    if tiles <= 0:
        raise ValueError("at least one tile")
    counted = rows.withColumn("_one", F.lit(1).cast("long"))
    scanned = ordered_scan(counted, keys, order, sums={"row_number": "_one"}).drop("_one")
    told = _same(scanned, rows.groupBy(*keys).agg(F.count("*").alias("_total")), keys)
    number, size, more = F.col("row_number") - 1, F.expr(f"_total div {tiles}"), F.col("_total") % tiles
    told = told.withColumns({"_at": number, "_size": size, "_more": more})
    # The first tiles hold one row more each, until the remainder is used up.
    tile = F.expr("CASE WHEN _at < _more * (_size + 1) THEN _at div (_size + 1) ELSE _more + (_at - _more * (_size + 1)) div _size END")
    return told.withColumn("tile", tile + 1).drop("_at", "_size", "_more", "_total")


def with_next(rows: DataFrame, keys: list[str], order: dict[str, Column], value: str, name: str) -> DataFrame:
    """The rows with the value of the row after them, as ``name``; null after the last one.

    ``order`` gives a numeric column for each column name that negates the order: the next row is the last one seen from the end.
    """
    back = rows.withColumns({f"_{n}": -c for n, c in order.items()}).withColumn("_here", F.struct(F.col(value).alias("v")))
    scanned = ordered_scan(back, keys, [f"_{n}" for n in order], lasts={"_next": ("_here", 1)})
    return scanned.withColumn(name, F.col("_next.v")).select(*rows.columns, name)


def framed(rows: DataFrame, keys: list[str], at: str, row_id: str, before: int, sums: dict[str, str], after: int = 0) -> DataFrame:
    """For every row sums over the rows of its keys from ``before`` below to ``after`` above its own ``at``, both included.

    Like a window with RANGE BETWEEN, for a whole-number column ``at`` and a unique ``row_id``. A frame's sum is the
    running sum at its end less that before its start: each row asks for both in one ordered
    pass, so frames of any length cost the same, and a key may span any number of tasks.
    Sums must be of whole or decimal numbers, which can be taken off exactly. Rows without a time get null.
    """
    if before < 0 or after < 0:
        raise ValueError("a frame holds its own row")
    totals = {f"_s{n}": f"_v{n}" for n in range(len(sums))}
    values = [F.coalesce(F.col(column), F.lit(0)).alias(v) for column, v in zip(sums.values(), totals.values(), strict=True)]
    none = [F.lit(0).cast(rows.schema[column].dataType).alias(v) for column, v in zip(sums.values(), totals.values(), strict=True)]
    timed = rows.where(F.col(at).isNotNull())
    at_long = F.col(at).cast("long")
    # Of equal times: starts of frames, then rows, then ends of frames.
    kinds = [(0, at_long - before, none), (1, at_long, values), (2, at_long + after, none)]
    asked = None
    for kind, place, columns in kinds:
        part = timed.select(*keys, place.alias("_at"), F.lit(kind).alias("_kind"), F.col(row_id).alias("_id"), *columns)
        asked = part if asked is None else asked.union(part)
    scanned = ordered_scan(asked, keys, ["_at", "_kind"], sums=totals).where("_kind <> 1")
    ends = [F.max(F.when(F.col("_kind") == 2, F.col(s))) - F.max(F.when(F.col("_kind") == 0, F.col(s))) for s in totals]
    found = scanned.groupBy(F.col("_id").alias(row_id)).agg(*[e.alias(name) for e, name in zip(ends, sums, strict=True)])
    return rows.join(found, row_id, "left")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null is one like any other."""
    right = right.withColumnsRenamed({key: f"_key_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(right[f"_key_{key}"])
    return left.join(right, same).drop(*(f"_key_{key}" for key in keys))

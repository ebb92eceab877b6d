"""Joins of intervals: overlap and containment, with or without keys, as equi-joins of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.workspace import stored

#: Rows of one side in one bin beyond which the bin is dealt out in parts.
BIN_ROWS = 10_000
LEFT, RIGHT = "l", "r"


def micros(at: str | Column) -> Column:
    """A time as a whole number, for the bounds of an interval."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is as long as the interval, by its exponent."""
    size = end - start
    return F.when(size <= 1, 0).otherwise(F.lit(64) - _leading_zeros(size - 1))


def _leading_zeros(number: Column) -> Column:
    """Zero bits before the first set bit of a positive long."""
    return F.lit(64) - F.length(F.bin(number))


def _side(rows: DataFrame, name: str, keys: list[str], span: tuple[str, str]) -> DataFrame:
    """The rows as one struct with their keys, bounds and level; those that are in no interval go."""
    start, end = (F.col(column).cast("long") for column in span)
    made = rows.select(
        *(F.col(key).alias(f"k{n}") for n, key in enumerate(keys)),
        start.alias("start"), end.alias("end"), F.struct(*rows.columns).alias(name),
    )
    usable = made.where("start < end").dropna(subset=[f"k{n}" for n in range(len(keys))])
    usable = usable.withColumn("own", _level(F.col("start"), F.col("end")))
    # Numbered and written once: copies of a row are dealt apart, the same way whenever a task runs again.
    return stored(usable.withColumn("copy", F.monotonically_increasing_id()), "intervals")


def _levels(side: DataFrame) -> list[int]:
    """The levels that occur: at most 64."""
    return sorted(row[0] for row in side.select("own").distinct().collect())


def _binned(side: DataFrame, levels: list[int]) -> DataFrame:
    """Each row in the bins it touches, at each given level from its own on: two bins a level at most."""
    at = F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("own")))
    spread = side.withColumn("level", at)
    first, last = (F.call_function("shiftright", c, F.col("level")) for c in (F.col("start"), F.col("end") - 1))
    return spread.withColumn("bin", F.explode(F.sequence(first, last)))


def _dealt(binned: DataFrame, name: str, place: list[str]) -> DataFrame:
    """Bin by bin, in how many parts of about ``BIN_ROWS`` a side is dealt; only bins with several parts."""
    parts = F.ceil(F.count("*") / BIN_ROWS).cast("int")
    return binned.groupBy(place).agg(parts.alias(name)).where(F.col(name) > 1)


def overlaps(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[str] | None = None
) -> DataFrame:
    """Pairs of rows whose half-open intervals meet and whose keys agree, as structs ``l`` and ``r``.

    A point is an interval of length one, so containment of points is a case of this. An
    interval of up to 2**n lies in one or two bins of that size. A pair is looked for at the
    level of the longer of both: each side stands in the bins of its own level, and of the
    greater ones that the other side has, so rows are copied twice for each such level at
    most. A pair that meets in two bins counts in that of the later start. No pair is formed
    that does not share a bin of the longer one's size.

    A bin with many rows of a side is dealt out: these rows in parts, the other side's copied
    to each part, so a moment that holds a third of all rows takes as many tasks as it needs.
    Rows with a null bound or key, or an interval that does not end after its start, meet
    nothing. Any column names may be the same on both sides.
    """
    keys = keys or []
    spans = {LEFT: left_span, RIGHT: right_span}
    sides = {name: _side(rows, name, keys, spans[name]) for name, rows in ((LEFT, left), (RIGHT, right))}
    levels = sorted({level for side in sides.values() for level in _levels(side)})
    if not levels:
        levels = [0]
    binned = {name: _binned(side, levels) for name, side in sides.items()}
    place = [*(f"k{n}" for n in range(len(keys))), "level", "bin"]
    deals = {name: _dealt(side, f"n_{name}", place) for name, side in binned.items()}
    dealt = stored(deals[LEFT].join(deals[RIGHT], place, "full").fillna(1, [f"n_{LEFT}", f"n_{RIGHT}"]), "bins")

    parts = {}
    for name, side in binned.items():
        other = RIGHT if name == LEFT else LEFT
        told = side.join(dealt, place, "left")
        own = F.pmod(F.xxhash64(name, "copy"), F.coalesce(f"n_{name}", F.lit(1)))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{other}", F.lit(1)) - 1))
        told = told.withColumn(f"p_{name}", own.cast("int")).withColumn(f"p_{other}", copies)
        told = told.withColumnsRenamed({"start": f"start_{name}", "end": f"end_{name}", "own": f"own_{name}"})
        parts[name] = told.drop(f"n_{LEFT}", f"n_{RIGHT}", "copy")
    met = parts[LEFT].join(parts[RIGHT], [*place, f"p_{LEFT}", f"p_{RIGHT}"])
    met = met.where((F.greatest("own_l", "own_r") == F.col("level")) & (F.col("start_l") < F.col("end_r")) & (F.col("start_r") < F.col("end_l")))
    once = F.call_function("shiftright", F.greatest("start_l", "start_r"), F.col("level")) == F.col("bin")
    return met.where(once).select(LEFT, RIGHT)


def totals_within(intervals: DataFrame, points: DataFrame, span: tuple[str, str], at: str, value: str) -> DataFrame:
    """``start, end, points, total`` of each distinct half-open interval with points in it: their number and the sum of a value.

    No pair of an interval and a point is formed, as their number grows with the square of the rows. The
    moments that have points are numbered in order, and summed in blocks of 1, 2, 4 and so on of them; an interval is
    cut into whole blocks, two of a size at most, which meet theirs. Sums are of the interval's own values only.
    """
    spans = intervals.select(*(F.col(name).cast("long").alias(as_) for name, as_ in zip(span, ("start", "end"), strict=True)))
    spans = stored(spans.where("start < end").distinct(), "spans")
    spots = points.select(F.col(at).cast("long").alias("t"), F.col(value).alias("v")).where("t is not null")
    spots = spots.groupBy("t").agg(F.count("*").alias("n"), F.sum("v").alias("total")).withColumn("spot", F.lit(1))
    bounds = spans.select(F.explode(F.array("start", "end")).alias("t")).withColumn("spot", F.lit(0))
    moments = spots.unionByName(bounds, allowMissingColumns=True).groupBy("t").agg(*(F.max(c).alias(c) for c in ("spot", "n", "total")))

    # Numbered range by range, each from the count of the ranges before it; the ranges are written, as others may come next time.
    placed = stored(moments.repartitionByRange("t").withColumn("part", F.spark_partition_id()), "moments")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("spot").alias("spots"))
    offsets = offsets.select("part", F.coalesce(F.sum("spots").over(before.orderBy("part")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("spot").over(before.partitionBy("part").orderBy("t")), F.lit(0))
    ranked = placed.withColumn("inside", inside).join(F.broadcast(offsets), "part")
    ranked = stored(ranked.select("t", (F.col("inside") + F.col("offset")).alias("rank"), "spot", "n", "total"), "ranks")
    for bound, name in (("start", "a"), ("end", "b")):
        spans = spans.join(ranked.select(F.col("t").alias(bound), F.col("rank").alias(name)), bound)
    spans = stored(spans.where("a < b"), "ranked-spans")

    levels = range((spans.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 1).bit_length())
    cut = []
    for level in levels:
        low, high = (F.call_function("shiftright", c, F.lit(level)) for c in (F.col("a") + ((1 << level) - 1), F.col("b")))
        for block, odd in ((low, low), (high - 1, high)):
            piece = F.struct(F.lit(level).alias("level"), block.alias("block"))
            cut.append(F.when((low < high) & (F.pmod(odd, F.lit(2)) == 1), piece))
    pieces = spans.select("start", "end", F.explode(F.array_compact(F.array(*cut))).alias("piece"))
    pieces = pieces.select("start", "end", "piece.level", "piece.block")
    blocks = ranked.where("spot = 1").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    blocks = blocks.groupBy("level", F.call_function("shiftright", F.col("rank"), F.col("level")).alias("block"))
    blocks = blocks.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    unit = ("block", "next")
    met = overlaps(*(side.withColumn("next", F.col("block") + 1) for side in (pieces, blocks)), unit, unit, ["level"])
    return met.groupBy(F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(
        F.sum("r.n").alias("points"), F.sum("r.total").alias("total")
    )

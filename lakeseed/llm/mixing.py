"""Mixing sources to target weights with a Pfair schedule.

Each source's documents, in the order of a hash of their ids, are cut into blocks of ``BLOCK_ROWS``. A
source of weight w, of weights that sum up to 1, must place its block j (from 0) in the slots from
floor(j / w) up to ceil((j + 1) / w), and in every slot the released block with the earliest deadline goes
next. At every slot a source is then less than one block away from its share of the slots so far. Weights
are whole numbers or exact fractions, so this holds however long the mix is.

The slots are made in stretches of the same length, each by itself, so any number of tasks can make them.
Where a stretch begins, every source has placed the whole part of its share or one block more. Giving
the blocks more to the earliest deadlines (``fair``) lets no later deadline pass. A run over the stretch before
from there ends in a state that can also be reached from every state at that stretch's start, so these ends are
where stretches meet: each is run again between its two of them. A stretch is as long as the slowest source needs
for a block, so that no block is on both sides of it.

The target weight of a source is given, or the square root of its rows. All rows are kept. The mix ends
(``in_mix``) with the first slot whose source has no block left; blocks left over then come in the order of their
deadlines, without gaps, those of sources without a weight last. A null source is a source of its own.
Rows that share an id stand next to each other; columns of the same names as the new ones are replaced. The
driver and every task hold one weight a source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.operators.skew import ordered_scan
from lakeseed.workspace import stored

BLOCK_ROWS = 64
#: Rows that a task ranks at a time; a source of any size is ranked in parts of about this size.
RANK_ROWS = 1024
#: Slots of a stretch, and the least number of them for each source.
STRETCH, SLOTS_PER_SOURCE = 1024, 8
#: Bits behind the point of a square root.
ROOT_BITS = 40
#: Stretches in a row that one task makes, and rows of a batch.
IN_A_ROW, ROWS = 64, 50_000
NEW = ("mix_block", "mix_slot", "mix_place", "in_mix")


def whole(weights: list) -> list[int]:
    """The same proportions in whole numbers, exactly."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    return [int(w * unit) for w in exact]


def fair(shares: list[int], slot: int) -> list[int]:
    """Blocks that each source has placed before a slot: whole shares, and one more for the earliest deadlines."""
    total = sum(shares)
    placed = [share * slot // total for share in shares]
    begun = [n for n, share in enumerate(shares) if share * slot % total]
    more = slot - sum(placed)
    for n in heapq.nsmallest(more, begun, key=lambda n: (-(-(placed[n] + 1) * total // shares[n]), n)):
        placed[n] += 1
    return placed


def run(shares: list[int], slot: int, placed: list[int], slots: int, until: list[int] | None = None) -> Iterator[int]:
    """The source of each slot, earliest deadline first, no more blocks than ``until``; counts in ``placed``."""
    total = sum(shares)
    going = [n for n, share in enumerate(shares) if share and (until is None or placed[n] < until[n])]
    waiting = [(placed[n] * total // shares[n], n) for n in going]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for now in range(slot, slot + slots):
        while waiting and waiting[0][0] <= now:
            _, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[n] + 1) * total // shares[n]), n))
        _, n = heapq.heappop(ready)
        yield n
        placed[n] += 1
        if until is None or placed[n] < until[n]:
            heapq.heappush(waiting, (placed[n] * total // shares[n], n))


def met(shares: list[int], stretch: int, slots: int) -> list[int]:
    """The blocks placed where a stretch begins."""
    if not stretch:
        return [0] * len(shares)
    before = (stretch - 1) * slots
    placed = fair(shares, before)
    for _ in run(shares, before, placed, slots):
        pass
    return placed


def schedule(shares: list[int], stretches: Iterator[int], slots: int) -> Iterator[tuple[int, int, int]]:
    """(source, its block, slot) of all slots of the stretches."""
    known: tuple[int, list[int]] | None = None
    for stretch in stretches:
        placed = known[1] if known and known[0] == stretch else met(shares, stretch, slots)
        known = stretch + 1, met(shares, stretch + 1, slots)
        for slot, n in enumerate(run(shares, stretch * slots, placed, slots, known[1]), stretch * slots):
            yield n, placed[n], slot


def stretch_size(shares: list[int], end: int) -> int:
    """Slots of a stretch of a schedule with so many slots."""
    slowest = -(-sum(shares) // min(share for share in shares if share))
    return min(end, max(STRETCH, SLOTS_PER_SOURCE * len(shares), slowest))


def group_of(source: Column | str) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def slots_of(rows: DataFrame, shares: list[int], blocks: list[int]) -> DataFrame:
    """number, block, slot of a schedule that is as long as any source may need to run out."""
    spark = rows.sparkSession
    total = sum(shares)
    end = min(-(-(n + 1) * total // share) for n, share in zip(blocks, shares, strict=True) if share)
    size = stretch_size(shares, end)
    count = -(-end // size)
    sent = spark.sparkContext.broadcast(shares)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = schedule(sent.value, iter(batch["id"].tolist()), size)
            while part := list(islice(rows, ROWS)):
                yield pd.DataFrame(part, columns=["number", "block", "slot"])

    tasks = max(min(count, spark.sparkContext.defaultParallelism), -(-count // IN_A_ROW))
    return spark.range(0, count, 1, tasks).mapInPandas(made, "number long, block long, slot long")


def placed_blocks(parts: DataFrame, sources: DataFrame, schedule: DataFrame) -> tuple[DataFrame, int]:
    """group, block, slot of every block, and the slot the mix ends with."""
    schedule = stored(schedule.join(F.broadcast(sources.select("number", "group", "blocks")), "number"), "slots")
    end = schedule.where("block >= blocks").agg(F.min("slot")).first()[0]
    mix = schedule.where(F.col("slot") < end).select("group", "block", "slot")
    # A block belongs to the part that its first row is in.
    first, last = F.expr(f"(before + {BLOCK_ROWS - 1}) div {BLOCK_ROWS}"), F.expr(f"(before + n - 1) div {BLOCK_ROWS}")
    own = parts.where(first <= last).select("group", F.explode(F.sequence(first, last)).alias("block"))
    done = mix.groupBy("group").agg(F.count("*").alias("done"))
    left = own.join(F.broadcast(sources.join(done, "group", "left")), "group").where("block >= coalesce(done, 0)")
    # A share of zero has no deadline; it comes last.
    deadline = F.when(F.col("weight") > 0, (F.col("block") + 1) / F.col("weight"))
    left = left.select("group", "block", "number", deadline.isNull().alias("late"), deadline.alias("deadline"), F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    left = ordered_scan(left, ["all"], ["late", "deadline", "number", "block"], sums={"upto": "one"})
    return mix.union(left.select("group", "block", F.col("upto") - 1 + end)), end


def mixed(documents: DataFrame, weights: Mapping | None = None) -> DataFrame:
    """The documents with their block, its slot, their place in the block, and whether the slot is in the mix."""
    spark = documents.sparkSession
    rows = documents.drop(*NEW)
    sizes = dict(rows.groupBy("source").count().toLocalIterator())
    names = sorted(sizes, key=lambda s: (s is not None, s))
    given = [weights.get(s, 0) if weights else Fraction(math.isqrt(sizes[s] << 2 * ROOT_BITS), 1 << ROOT_BITS) for s in names]
    if any(w < 0 for w in given) or (given and not any(given)):
        raise ValueError("weights must be positive for some source and negative for none")
    if not names:
        return rows.select("*", *(F.lit(None).cast("long").alias(name) for name in NEW[:3]), F.lit(False).alias(NEW[3]))
    shares = whole(given)
    blocks = [-(-sizes[s] // BLOCK_ROWS) for s in names]
    bits = [max(1, (sizes[s] // RANK_ROWS).bit_length()) for s in names]
    table = [
        ("" if s is None else f"={s}", n, blocks[n], shares[n] / sum(shares), 64 - bits[n]) for n, s in enumerate(names)
    ]
    sources = spark.createDataFrame(table, "group string, number long, blocks long, weight double, shift int")

    hashed = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))
    known = F.broadcast(sources.select(F.col("group").alias("_group"), F.col("shift").alias("_shift")))
    part = F.expr("shiftrightunsigned(_hash, _shift)")

    def in_parts(frame: DataFrame) -> DataFrame:
        frame = frame.withColumns({"_hash": hashed, "_group": group_of("source")})
        return frame.join(known, "_group").withColumn("_part", part)

    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = in_parts(rows.select("doc_id", "source")).groupBy(F.col("_group").alias("group"), F.col("_part").alias("part"))
    parts = parts.agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = stored(parts, "parts")
    slots, end = placed_blocks(parts, sources, slots_of(rows, shares, blocks))

    # For each part the slots of its blocks, in a row, which may begin and end within a block.
    block = F.expr(f"sequence(before div {BLOCK_ROWS}, (before + n - 1) div {BLOCK_ROWS})")
    told = parts.select("group", "part", "before", F.explode(block).alias("block")).join(slots, ["group", "block"])
    told = told.groupBy(F.col("group").alias("_of_group"), F.col("part").alias("_of_part")).agg(
        F.first("before").alias("_before"), F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda b: b["slot"]).alias("_slots")
    )
    # Whole rows are exchanged once: by group and part, for their ranks and for what is known of the part.
    within = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("_hash", "doc_id"))
    ranked = in_parts(rows).withColumn("_within", within)
    found = ranked.join(told, (ranked["_group"] == told["_of_group"]) & (ranked["_part"] == told["_of_part"]))
    found = found.withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    found = found.withColumn("mix_block", F.expr(f"_rank div {BLOCK_ROWS}"))
    found = found.withColumn("mix_slot", F.col("_slots")[(F.col("mix_block") - F.expr(f"_before div {BLOCK_ROWS}")).cast("int")])
    found = found.withColumn("mix_place", F.col("_rank") % BLOCK_ROWS).withColumn("in_mix", F.col("mix_slot") < end)
    return found.select(*rows.columns, *NEW)

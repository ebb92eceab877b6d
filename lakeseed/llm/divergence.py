"""Source divergence audit: how far the word use of a source lies from its language's other sources.

Terms are runs of letters A-Z, lower-cased, and of characters above ASCII. Each language keeps the terms that
``MIN_DOCUMENTS`` of its documents or more hold. A term's share p in a group is
1 + floor(``SCALE`` * (count + ``PRIOR``) / (N + ``PRIOR`` * V)) with N the counts of all V kept terms in the
group; the divergence of two groups is the sum of \\|p - q\\| over all kept terms.

The sums are taken over run-length columns. A language's vocabulary is put in the order of the terms' counts,
so that terms with equal counts are neighbours, and cut into ranges of up to ``RANGE`` terms. In a range every
source is a column; the terms are reordered once more to bring equal columns together, each column is coded as
runs of one count, and for a pair of sources the bounds of both are united: between two bounds \\|p - q\\| is
one number, which counts as often as the stretch is long. Terms of a range that neither source holds are one
run without a row. Pairs are taken in tiles of ``TILE`` by ``TILE`` sources, so a task holds the columns of
two tiles of one range, however many sources and terms there are.

Counts are added up inside the tasks that read the texts before anything is exchanged, so a hot source or word
is a row for each task. Null texts, languages and sources are empty strings; every document counts, repeated
rows as often as they occur; a group without kept terms has shares of its own (of prior counts alone); other
columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.workspace import stored

MIN_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
#: Ranks of the terms that set a source apart.
TOP = 50
#: Terms of a range, and sources of a tile.
RANGE, TILE = 4_096, 64
#: Counts that a task holds before it passes them on.
HELD = 400_000

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COUNTS = "lang string, source string, term string, n long, df long"


def counted(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, df: how often, and in how many documents, a source uses a term.

    A row with a null term stands for every language and source that occur.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch[name].to_pylist() for name in ("lang", "source", "text")), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                # Bytes know no capitals but A-Z.
                terms = TERM.findall(text.encode().lower().decode())
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    rows = documents.select(*(F.coalesce(name, F.lit("")).alias(name) for name in ("lang", "source", "text")))
    every = rows.mapInArrow(count, COUNTS).groupBy("lang", "source", "term")
    return stored(every.agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, df) in held.items():
        terms = [None, *n]
        columns = [pa.array([name] * len(terms), pa.string()) for name in (lang, source)]
        columns += [pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """A term's share, in whole numbers."""
    of = [c if isinstance(c, Column) else F.col(c) for c in (count, total, kept)]
    of = [c.cast("decimal(19,0)") for c in of]
    above, below = (of[0] + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), of[1] + of[2] * PRIOR
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def vocabulary(counts: DataFrame) -> DataFrame:
    """lang, term, n, range: the kept terms of each language, in ranges of neighbours by their counts."""
    alike = F.bit_xor(F.xxhash64("source", "n")).alias("alike")
    terms = counts.where("term is not null").groupBy("lang", "term")
    terms = terms.agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.count("*").alias("held"), alike)
    order = ["lang", "held", "n", "alike", "term"]
    placed = terms.where(F.col("df") >= MIN_DOCUMENTS).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # The bounds of the parts come from a sample, so the numbers are written before they are used.
    placed = stored(placed, "vocabulary")
    at = F.row_number().over(Window.partitionBy("part", "lang").orderBy(*order[1:])) - 1
    return placed.select("lang", "term", "n", F.struct("part", F.floor(at / RANGE).alias("cut")).alias("range"))


def grouped(counts: DataFrame, kept: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, total, V, zero, tile: each group's sum, its share of a term it lacks, and its tile."""
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = kept.groupBy("lang").agg(F.count("*").alias("V"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.fillna(0, ["total", "V"]).withColumn("tile", F.floor(number / TILE))
    zero = F.when(F.col("V") > 0, share(F.lit(0), "total", "V"))
    return groups.withColumn("zero", zero)


def runs(columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns with their rows reordered, and the starts of each column's runs of one value."""
    columns = columns[:, np.lexsort(columns)]
    return columns, [np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) for column in columns]


def pair_sums(columns: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The sums of the differences of two columns, for every pair of them."""
    columns, starts = runs(columns)
    out = np.zeros(len(pairs), np.int64)
    for at, (a, b) in enumerate(pairs):
        bounds = np.union1d(starts[a], starts[b])
        length = np.diff(np.r_[bounds, columns.shape[1]])
        out[at] = (np.abs(columns[a, bounds] - columns[b, bounds]) * length).sum()
    return out


SUMS = "lang string, a string, b string, f long, terms long"
COLUMNS = ["lang", "a", "b", "f", "terms"]


def tile_sums(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """For all pairs between two tiles of sources: the sum of differences over the terms of one range."""
    if cells.empty or groups.empty:
        return pd.DataFrame(columns=COLUMNS, dtype=object)
    groups = groups.sort_values("source", ignore_index=True)
    row = pd.Series(groups.index, index=groups.source)
    terms, at = np.unique(cells.term.to_numpy(str), return_inverse=True)
    columns = np.repeat(groups.zero.to_numpy(np.int64)[:, None], len(terms), axis=1)
    columns[row[cells.source].to_numpy(), at] = cells.share.to_numpy(np.int64)
    first, last = (np.flatnonzero(groups.tile == tile).tolist() for tile in (cells.low.iloc[0], cells.high.iloc[0]))
    pairs = [(a, b) for a in first for b in last if a < b]
    names = groups.source.tolist()
    sums = pair_sums(columns, pairs) if len(terms) else [0] * len(pairs)
    rows = [(groups.lang.iloc[0], names[a], names[b], int(f), len(terms)) for (a, b), f in zip(pairs, sums, strict=True)]
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def pairs_of(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of every source from every other one of its language."""
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    met = cells.join(tiles, "lang").withColumn("other", others)
    ends = (F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    met = met.select("lang", "range", *ends, "source", "term", "share")
    keys = ["lang", "range", "low", "high"]
    # Every range that any source of the two tiles has a term in needs all sources of both.
    wanted = met.select(*keys).distinct()
    both = F.array_distinct(F.array("low", "high"))
    needed = wanted.withColumn("tile", F.explode(both)).join(groups.select("lang", "tile", "source", "zero"), ["lang", "tile"])
    needed = needed.select(*(F.col(name).alias(name) for name in needed.columns))
    sums = met.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(tile_sums, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))
    # Pairs of groups are what is asked for, so the list of them is as long as the result.
    of = groups.select("lang", "source", "zero", "V")
    every = of.alias("a").join(of.alias("b"), "lang").where("a.source < b.source")
    every = every.select("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), "a.V", (F.col("a.zero") - F.col("b.zero")).alias("off"))
    full = every.join(sums, ["lang", "a", "b"], "left").fillna(0, ["f", "terms"])
    # The terms that neither source holds are one run.
    rest = F.coalesce(F.abs("off") * (F.col("V") - F.col("terms")), F.lit(0))
    full = full.select("lang", F.array("a", "b").alias("ends"), (F.col("f") + rest).alias("value"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("j"))))
    full = full.withColumn("side", sides)
    return full.select("lang", F.col("ends")[F.col("side.i")].alias("source"), F.col("ends")[F.col("side.j")].alias("item"), "value")


def audited(documents: DataFrame) -> DataFrame:
    """The pair and term parts of every source: lang, source, part, item, value, rank."""
    counts = counted(documents)
    kept = vocabulary(counts)
    known = kept.select("lang", "term", F.col("n").alias("whole"), "range")
    cells = stored(counts.where("n > 0").drop("df").join(known, ["lang", "term"]), "cells")
    groups = stored(grouped(counts, kept, cells), "groups")
    # A row for each language, written so that its size is known when it is joined.
    sums = stored(kept.groupBy("lang").agg(F.sum("n").alias("all")), "sums")
    cells = cells.join(groups.drop("zero"), ["lang", "source"]).withColumn("share", share("n", "total", "V"))

    apart = cells.join(sums, "lang").withColumn("value", F.col("share") - share("whole", "all", "V")).where("value > 0")
    order = [F.desc("value"), F.asc("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    apart = apart.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    apart = apart.withColumn("rank", rank).where(F.col("rank") <= TOP)
    pairs = pairs_of(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.union(apart)

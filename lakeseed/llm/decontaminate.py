"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over all token windows.

Texts are lower-cased (A-Z) and cut into words of letters, digits and anything beyond ASCII. An item's
windows are its runs of ``WINDOW`` words; a shorter item is one window. Spark makes the windows, each once
for every item that holds it, and writes them in blocks of about ``BLOCK_WINDOWS``. One block after another
is broadcast, all texts are scanned with it, the texts with hits are written by their hash and the broadcast
is freed; so driver and tasks hold a single block, however large the benchmark is. The hits of a text in
all blocks are then united, and joined to the documents by the hash.

Null texts and texts without a word have no words and no hits; items without a word have no windows;
items that share an id are one item and an item without an id hits words but is not counted. Repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import stored

WINDOW = 13
BLOCK_WINDOWS = 500_000
#: A document is contaminated when at least one word in this many is hit.
HIT_SHARE = 20

NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def windows(benchmark: DataFrame) -> DataFrame:
    """size, window, item: every window once for each item that holds it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item_id, text in zip(batch.item, batch.text, strict=True):
                found = words(text)
                k = min(WINDOW, len(found))
                if k:
                    held = {b" ".join(found[p : p + k]) for p in range(len(found) - k + 1)}
                    yield pd.DataFrame({"size": k, "window": list(held), "item": item_id})

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInPandas(cut, "size int, window binary, item string").distinct()


def blocks(benchmark: DataFrame, size: int) -> Iterator[dict[int, dict[bytes, tuple]]]:
    """Windows by length, each with the ids of its items; about ``size`` rows of ``windows`` in a block."""
    made = stored(windows(benchmark), "benchmark-windows")
    n = -(-made.count() // size)
    part = F.pmod(F.xxhash64("window", "item"), F.lit(n))
    for number in range(n):
        block: dict[int, dict[bytes, tuple]] = {}
        rows = made if n == 1 else made.where(part == number)
        for k, window, item in rows.toLocalIterator():
            same = block.setdefault(k, {})
            key = bytes(window)
            same[key] = same.get(key, ()) + (() if item is None else (item,))
        yield block


def occurrences(found: list[bytes], block: dict, vocabulary: frozenset) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that are windows of the block, and the items they come from."""
    spans, items = [], set()
    known = bytes(map(vocabulary.__contains__, found))
    for k, windows in block.items():
        run = b"\x01" * k
        at = known.find(run)
        while at >= 0:
            same = windows.get(b" ".join(found[at : at + k]))
            if same is not None:
                spans.append((at, at + k))
                items.update(same)
            at = known.find(run, at + 1)
    return spans, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


HITS = "text_hash binary, n_words long, starts array<long>, ends array<long>, items array<string>"


def _found(texts: DataFrame, block: dict) -> DataFrame:
    """``HITS`` of the texts that a block's windows hit, written."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = frozenset(w for same in shared.value.values() for key in same for w in key.split(b" "))
        for batch in batches:
            rows = []
            for text_hash, text in zip(batch.text_hash, batch.text, strict=True):
                said = words(text)
                spans, items = occurrences(said, shared.value, vocabulary)
                if spans:
                    spans = union(spans)
                    rows.append((text_hash, len(said), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["text_hash", "n_words", "starts", "ends", "items"])

    made = stored(texts.mapInPandas(scan, HITS), "benchmark-hits")
    shared.destroy()
    return made


def _united(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for s, e in zip(starts, ends, strict=True):
        spans = union(list(zip(np.asarray(s).tolist(), np.asarray(e).tolist(), strict=True)))
        rows.append(([x for x, _ in spans], [y for _, y in spans]))
    return pd.DataFrame(rows, columns=["starts", "ends"])


def hits(texts: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``HITS``, one row for each different text with hits: its words, starts and ends of hit spans, ids of the items."""
    texts = texts.select(text_hash(), "text").where("text IS NOT NULL")
    columns = ["starts", "ends", "items"]
    found = [_found(texts, block).withColumn("block", F.lit(i)) for i, block in enumerate(blocks(benchmark, block_windows))]
    if not found:
        return texts.sparkSession.createDataFrame([], HITS)
    # Copies of a text have the same hits in a block: one of them, then one list for each block.
    first = [F.first(c).alias(c) for c in ("n_words", *columns)]
    once = reduce(DataFrame.union, found).groupBy("text_hash", "block").agg(*first)
    every = F.collect_list(F.struct(*columns)).alias("every")
    whole = once.groupBy("text_hash").agg(F.first("n_words").alias("n_words"), every)
    lists = whole.select("text_hash", "n_words", *(F.flatten(F.col("every")[c]).alias(c) for c in columns))
    merge = F.pandas_udf(_united, "starts array<long>, ends array<long>")
    joint = lists.withColumn("joint", merge("starts", "ends"))
    return joint.select("text_hash", "n_words", "joint.starts", "joint.ends", F.array_distinct("items").alias("items"))


def text_hash() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash")


def counted(text: Column) -> Column:
    """Words of a text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in texts], dtype="int64")

    return count(text)


def n_hit() -> Column:
    lengths = F.zip_with("starts", "ends", lambda s, e: e - s)
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))


def is_contaminated() -> Column:
    return (n_hit() > 0) & (n_hit() * HIT_SHARE >= F.col("n_words"))


def judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words, items found and the verdict of every document."""
    rows = documents.select("doc_id", text_hash(), counted(F.col("text")).alias("n_words"))
    rows = rows.join(hits(documents, benchmark).drop("n_words"), "text_hash", "left")
    ids = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = hits(documents, benchmark).where(is_contaminated()).select(F.col("text_hash").alias("bad_hash"))
    return documents.join(bad, F.unhex(F.sha2(documents["text"].cast("binary"), 256)) == bad["bad_hash"], "left_anti")


def _cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for whole, s, e in zip(text, starts, ends, strict=True):
        if whole is None or not len(s):
            out.append(whole)
            continue
        raw = whole.encode()
        inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        left, at = [], 0
        for first, last in zip(s, e, strict=True):
            left.append(raw[at : edges[2 * first]])
            at = edges[2 * last - 1]
        out.append(b"".join([*left, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def without_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text of every document with the hit words cut out."""
    rows = documents.select("doc_id", "text", text_hash()).join(hits(documents, benchmark), "text_hash", "left")
    none = F.array().cast("array<long>")
    cut = F.pandas_udf(_cut, "string")
    return rows.select("doc_id", cut("text", F.coalesce("starts", none), F.coalesce("ends", none)).alias("text"))

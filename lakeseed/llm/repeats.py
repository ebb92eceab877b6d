"""Repeated passages: a family of anchor indexes that grows by batches and merges geometrically.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts earlier, in a document with a
smaller id or before it in the same one. Every window of ``LENGTH`` bytes has an anchor, the smallest hash
of its ``GRAM``-byte grams (of equal ones the first), so equal windows have equal anchors at equal places.
The index holds the texts at anchors only, one entry for each run of windows with the same anchor. It takes the place of
suffix arrays: entries are ordered by a hash of the anchor's gram and a hash of the string that the run's
windows span, not by the bytes that follow, and equal spans are found by equal hashes, not by common prefixes.

* A batch of documents becomes an index in each of its tasks. Runs that repeat within a task are found there,
  and only the first of them goes on, so a passage in any number of documents is one entry of a task.
* The batch is exchanged by anchor and scanned together with the existing levels, in order. A run whose
  whole span stands earlier in the order is covered. New spans become a new level, and before a batch is
  added neighbouring levels of like size are merged, so there are logarithmically many. With the ``BATCHES`` of the
  registered query no levels merge; callers that add more batches see merges.
* Anchors with several spans are where matches begin and end. Their spans are cut from the texts and all
  their windows are compared, anchor by anchor; anchors with very many spans are dealt out in parts whose
  first windows are then compared by hash in an aggregate.

Levels are written to the shared folder, so lost executors recompute no batch but the one at hand. A null or
short text has nothing to remove. Null ids come first. Rows that share an id are one document that begins
several times: equal starts do not cover each other, and each row gets its own spans. Repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import stored

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Batches that a whole table is added in.
BATCHES = 2
#: Spans of an anchor that a task compares at a time.
PART = 2_000
#: Lists of this many documents or spans are sent to every task; longer ones are joined.
SENT = 2_000_000
#: Positions of a text that are hashed at a time.
CHUNK = 1 << 18
LEAST_ID = -(1 << 63)

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FACTORS = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
LEVEL, COVER, VARIANT, WINDOW = range(4)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTORS[2]
    x = (x ^ (x >> np.uint64(29))) * FACTORS[1]
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, CHUNK + LENGTH + 2), powers(INVERSE, CHUNK + LENGTH + 2)


def gram_hashes(raw: bytes, width: int = GRAM) -> np.ndarray:
    """A hash of the ``width`` bytes (a multiple of eight) from every position."""
    n = len(raw) - width + 1
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = eights[:n] * FACTORS[0]
    for i in range(8, width, 8):
        out ^= out >> np.uint64(31)
        out += eights[i : i + n]
        out *= FACTORS[i // 8 % 4]
    return mix(out)


def range_hashes(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the gram sequences [start, end)."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * UP[: len(grams)], out=sums[1:])
    return (sums[ends] - sums[starts]) * DOWN[starts]


def runs(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Of all runs of windows with the same anchor: hash of the gram, hash of the span, start, windows."""
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(raw) - LENGTH + 1, CHUNK):
        piece = raw[at : at + CHUNK + LENGTH - 1]
        grams = gram_hashes(piece)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        rest = SPAN - 64
        anchors = (np.minimum(least[: len(least) - rest], least[rest:]) & low).astype(np.int64)
        starts = np.flatnonzero(np.diff(anchors, prepend=-1))
        windows = np.diff(np.append(starts, len(anchors)))
        anchor = anchors[starts]
        spans = range_hashes(grams, starts, starts + windows + SPAN - 1)
        shape = mix(spans + windows.astype(np.uint64) * FACTORS[3] + (anchor - starts).astype(np.uint64) * FACTORS[1])
        yield grams[anchor].view(np.int64), shape.view(np.int64), starts + at, windows


def packed(start, windows, mark, new: int = 0):
    """Start, whether new, number of windows and a mark of the text in one number, ordered by start."""
    return (start << 32) | (new << 31) | (windows << 24) | mark


def start_of(place):
    return place >> 32


def windows_of(place):
    return (place >> 24) & 127


def joined(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same row that touch as one; rows, starts and ends ascend."""
    if not len(rows):
        return rows, starts, ends
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > ends[:-1])
    first = np.flatnonzero(fresh)
    return rows[first], starts[first], ends[np.append(first[1:], len(rows)) - 1]


NAMES = ["kind", "core", "shape", "doc", "place", "size"]
ROWS = "kind int, core long, shape long, doc long, place long, size int"


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def _covers(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    places = packed(starts, 0, marks)
    spread = mix((docs ^ starts).view(np.uint64)).view(np.int64)
    n = len(docs)
    return np.full(n, COVER), spread, np.zeros(n, np.int64), docs, places, ends - starts


def texts_of(documents: DataFrame, *more: str) -> DataFrame:
    """doc, mark, text: the id (the least number for null) and a mark that tells texts of one id apart."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    return documents.select(doc.alias("doc"), F.pmod(F.xxhash64("text"), F.lit(1 << 24)).alias("mark"), "text", *more)


def suffix_arrays(texts: DataFrame) -> DataFrame:
    """Level rows with the first of every span of a task, and cover rows for the others."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = batch["doc"].to_numpy(), batch["mark"].to_numpy()
            parts, owners = [], []
            for i in np.argsort(docs, kind="stable"):
                text = batch["text"][int(i)].as_py()
                for part in runs((text or "").encode()):
                    parts.append(part)
                    owners.append(np.full(len(part[0]), i))
            if not parts:
                continue
            core, shape, start, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.concatenate(owners)
            del parts, owners
            key = mix(core.view(np.uint64) * FACTORS[3] ^ shape.view(np.uint64))
            order = np.argsort(key, kind="stable")
            fresh = np.append(True, (np.diff(core[order]) != 0) | (np.diff(shape[order]) != 0))
            first = order[fresh][np.cumsum(fresh) - 1]
            again = (docs[owner[order]] != docs[owner[first]]) | (start[order] != start[first])
            later = np.sort(order[again])
            row, begin, end = joined(owner[later], start[later], start[later] + windows[later] + LENGTH - 1)
            yield _batch(*_covers(docs[row], marks[row], begin, end))
            kept = order[fresh]
            place = packed(start[kept], windows[kept], marks[owner[kept]], 1)
            n = len(kept)
            yield _batch(np.full(n, LEVEL), core[kept], shape[kept], docs[owner[kept]], place, np.zeros(n, np.int64))

    return texts.mapInArrow(build, ROWS)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan sorted entries: cover rows, variant rows of anchors with several spans, and new level rows."""
    past = None  # core, shape, doc and place of the span at hand's first entry, and whether its core had another
    for batch in batches:
        kind, core, shape, doc, place = (batch[c].to_numpy() for c in NAMES[:5])
        passed = kind == COVER
        if passed.any():
            yield _batch(*(batch[c].to_numpy()[passed] for c in NAMES))
            core, shape, doc, place = (x[~passed] for x in (core, shape, doc, place))
        if not len(core):
            continue
        if past is not None:
            core, shape, doc, place = (np.concatenate(([p], x)) for p, x in zip(past, (core, shape, doc, place), strict=False))
        fresh = np.append(True, (np.diff(core) != 0) | (np.diff(shape) != 0))
        first = np.flatnonzero(fresh)
        own = first[np.cumsum(fresh) - 1]
        later = np.flatnonzero((doc != doc[own]) | (start_of(place) != start_of(place[own])))
        marks = place[later] & 0xFFFFFF
        begin = start_of(place[later])
        yield _batch(*_covers(doc[later], marks, begin, begin + windows_of(place[later]) + LENGTH - 1))
        same = core[first[1:]] == core[first[:-1]]
        several = np.append(False, same) | np.append(same, False)
        several[0] |= past is not None and past[4]
        # The last span's core may go on in the next batch; it is told then.
        done = first[:-1]
        yield from _told(core, shape, doc, place, done, several[:-1])
        end = first[-1]
        past = (core[end], shape[end], doc[end], place[end], bool(several[-1]))
    if past is not None:
        core, shape, doc, place = (np.array([p]) for p in past[:4])
        yield from _told(core, shape, doc, place, np.array([0]), np.array([past[4]]))


def _told(core, shape, doc, place, at, several) -> Iterator[pa.RecordBatch]:
    new = at[(place[at] >> 31) & 1 == 1]
    n = len(new)
    yield _batch(np.full(n, LEVEL), core[new], shape[new], doc[new], place[new] & ~(1 << 31), np.zeros(n, np.int64))
    many = at[several]
    n = len(many)
    yield _batch(np.full(n, VARIANT), core[many], shape[many], doc[many], place[many] & ~(1 << 31), np.zeros(n, np.int64))


class Family:
    """Levels of suffix arrays; each batch is matched against all of them and becomes a level."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def merge(self) -> None:
        """Neighbouring levels of like size, the newest first, become one."""
        while len(self.levels) > 1 and 2 * self.levels[-1][0] >= self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            rows = a.union(b).repartition("core").sortWithinPartitions("core", "shape")
            self.levels.append((n + m, stored(rows, "repeats-level")))

    def add(self, texts: DataFrame) -> None:
        self.merge()
        rows = suffix_arrays(texts)
        for _, level in self.levels:
            rows = rows.union(level)
        rows = rows.repartition("core").sortWithinPartitions("core", "shape", "doc", "place")
        found = stored(rows.mapInArrow(_scanned, ROWS), "repeats-batch")
        level = found.where(F.col("kind") == LEVEL)
        self.levels.append((level.count(), level))
        self.found.append(found)

    def rows(self, kind: int) -> DataFrame:
        """The cover or variant rows of all batches."""
        out = self.found[0]
        for found in self.found[1:]:
            out = out.union(found)
        return out.where(F.col("kind") == kind)


def _sent(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= SENT else rows


def spans_of(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """core, part, parts, doc, place, span: the bytes of every variant."""
    variants = variants.select("core", "doc", "place").distinct()
    parts = variants.groupBy("core").agg(F.ceil(F.count("*") / PART).alias("parts"))
    variants = variants.join(parts, "core")
    mark = F.col("place").bitwiseAND(F.lit((1 << 24) - 1))
    held = variants.groupBy("doc", mark.alias("mark")).agg(F.collect_list(F.struct("core", "place", "parts")).alias("held"))
    held = stored(held, "repeats-held")
    ids = held.select("doc").distinct()
    near = texts.join(_sent(ids, ids.count()), "doc", "left_semi").join(held, ["doc", "mark"])

    @F.pandas_udf("array<struct<core: long, place: long, parts: long, span: binary>>")
    def cut(texts: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for text, items in zip(texts, held, strict=True):
            raw = (text or "").encode()
            found = []
            for item in items:
                at, n = start_of(item["place"]), windows_of(item["place"])
                span = raw[at : at + n + LENGTH - 1]
                found.append({"core": item["core"], "place": item["place"], "parts": item["parts"], "span": span})
            out.append(found)
        return pd.Series(out, dtype=object)

    rows = near.select("doc", F.explode(cut("text", "held")).alias("v")).select("v.core", "v.parts", "doc", "v.place", "v.span")
    return rows.withColumn("part", F.pmod(F.xxhash64("doc", "place"), "parts"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare all windows of each (core, part): cover rows, and first windows of anchors in several parts."""
    rest = None
    for batch in batches:
        table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        core, part = table["core"].to_numpy(), table["part"].to_numpy()
        last = np.flatnonzero((core != core[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = table.slice(cut)
        if cut:
            yield from _windows(table.slice(0, cut))
    if rest is not None and len(rest):
        yield from _windows(rest)


def _windows(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    core, part, parts, doc, place = (table[c].to_numpy() for c in ("core", "part", "parts", "doc", "place"))
    spans = table["span"].to_pylist()
    hashes = []
    for span, own in zip(spans, core.view(np.uint64), strict=True):
        grams = gram_hashes(span, 8)
        starts = np.arange(len(span) - LENGTH + 1)
        hashes.append(mix(range_hashes(grams, starts, starts + LENGTH - 7) ^ own))
    counts = np.array([len(h) for h in hashes])
    row = np.repeat(np.arange(len(spans)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.concatenate(hashes)
    begin = start_of(place)[row] + offset
    order = np.lexsort((begin, doc[row], part[row], window))
    fresh = np.append(True, (np.diff(window[order]) != 0) | (np.diff(part[row][order]) != 0))
    first = order[fresh][np.cumsum(fresh) - 1]
    again = (doc[row[order]] != doc[row[first]]) | (begin[order] != begin[first])
    later = np.sort(order[again])
    owner, starts, ends = joined(row[later], begin[later], begin[later] + LENGTH)
    yield _batch(*_covers(doc[owner], place[owner] & 0xFFFFFF, starts, ends))
    open_ = order[fresh]
    open_ = open_[parts[row[open_]] > 1]
    n = len(open_)
    marks = place[row[open_]] & 0xFFFFFF
    yield _batch(
        np.full(n, WINDOW), window[open_].view(np.int64), np.zeros(n, np.int64), doc[row[open_]], packed(begin[open_], 0, marks), np.zeros(n, np.int64)
    )


def covers(texts: DataFrame, family: Family) -> DataFrame:
    """doc, mark, covered: the runs that go from every text that repeats something."""
    spans = spans_of(texts, family.rows(VARIANT)).repartition("core", "part").sortWithinPartitions("core", "part", "doc", "place")
    compared = stored(spans.mapInArrow(_compared, ROWS), "repeats-windows")
    windows = compared.where(F.col("kind") == WINDOW)
    firsts = windows.groupBy("core").agg(F.min(F.struct("doc", (F.col("place") / (1 << 32)).cast("long").alias("start"))).alias("first"))
    later = windows.join(firsts, "core").where(
        (F.col("doc") != F.col("first.doc")) | (F.shiftright("place", 32) != F.col("first.start"))
    )
    rows = family.rows(COVER).select("doc", "place", "size").union(compared.where(F.col("kind") == COVER).select("doc", "place", "size"))
    rows = rows.union(later.select("doc", "place", F.lit(LENGTH).alias("size")))
    place = F.struct(F.shiftright("place", 32).alias("start"), "size")
    mark = F.col("place").bitwiseAND(F.lit((1 << 24) - 1))
    found = rows.groupBy("doc", mark.alias("mark")).agg(F.collect_list(place).alias("covered"))

    @F.pandas_udf("array<struct<start: long, size: int>>")
    def merged(lists: pd.Series) -> pd.Series:
        out = []
        for spans in lists:
            starts, ends = [], []
            for start, end in sorted((c["start"], c["start"] + c["size"]) for c in spans):
                if starts and start <= ends[-1]:
                    ends[-1] = max(end, ends[-1])
                else:
                    starts.append(start)
                    ends.append(end)
            out.append([{"start": a, "size": b - a} for a, b in zip(starts, ends, strict=True)])
        return pd.Series(out, dtype=object)

    return found.select("doc", "mark", merged("covered").alias("covered"))


def kept_bytes(text: str | None, covered) -> tuple[int, int, int, list[bytes]]:
    """Bytes, removed bytes, removed runs and what is kept of a text."""
    raw = (text or "").encode()
    kept, at, removed, n = [], 0, 0, 0
    spans = sorted((c["start"], c["start"] + c["size"]) for c in covered) if covered is not None else ()
    for start, end in spans:
        if start > at or not n:
            kept.append(raw[at:start])
            n += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    return len(raw), removed, n, [*kept, raw[at:]]


def _matched(documents: DataFrame, batches: int) -> DataFrame:
    """doc_id, text and covered spans of every document."""
    texts = texts_of(documents)
    family = Family()
    edges = texts.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [0.5])).first()[0] or []
    edges = sorted(set(edges))[: batches - 1]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = texts if low is None else texts.where(F.col("doc") > low)
        family.add(part if high is None else part.where(F.col("doc") <= high))
    found = stored(covers(texts, family), "repeats-covers")
    size = found.agg(F.sum(F.size("covered"))).first()[0] or 0
    return texts_of(documents, "doc_id").join(_sent(found, size), ["doc", "mark"], "left")


def measured(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what is kept of every document."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def measure(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, covered, strict=True):
            n_bytes, removed, n, kept = kept_bytes(text, spans)
            digest = hashlib.sha256()
            for part in kept:
                digest.update(part)
            rows.append((n_bytes, removed, n, digest.hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _matched(documents, batches).select("doc_id", measure("text", "covered").alias("m")).select("doc_id", "m.*")


def without_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id and what is left of every text; a character cut in half is left out."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, covered: pd.Series) -> pd.Series:
        left = (b"".join(kept_bytes(t, c)[3]).decode(errors="ignore") if t is not None else None for t, c in zip(texts, covered, strict=True))
        return pd.Series(list(left), dtype=object)

    return _matched(documents, batches).select("doc_id", cut("text", "covered").alias("text"))

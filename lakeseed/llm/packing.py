"""Packing: deficit round-robin over source queues fills every window to target token proportions.

Every document becomes its tokens and an end token, and joins the queue of its source: the queue's tokens in
the order of the parts the table was read in. A queue is cut into blocks of ``BLOCK`` tokens, so documents
are cut only at the ends of blocks. In the round of each window of ``WINDOW`` tokens a queue's deficit grows
by its share of the window; it is served the blocks that the deficit covers and carries the rest on to the
next window. A queue is thus always less than one block behind its share, and one that has run out leaves
its turn to the others.

A queue's block j is served in the round in which its quanta first reach (j + 1) blocks, so no window waits
for the one before it: the blocks of all queues are ordered by round and queue, and a running sum over range
parts gives each its place. Deficits carry over from part to part of the table the same way, as every part
knows the tokens that its queues hold in earlier parts. What a queue leaves after its last whole block is
cut into powers of two; these come last, from large to small, so they need no padding either. Windows are
full but the very last one.

Shares are each queue's tokens, so windows look like the whole corpus until the end, or given weights;
queues without a weight come after the others. A null text has the end token only, a null source is a
queue of its own. Repeated rows are documents of their own; other columns are ignored; an empty table has no
pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeseed.operators.skew import ordered_scan
from lakeseed.workspace import bucketed, stored

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1
WINDOW = 2048
#: Tokens of a block; WINDOW is a multiple of it, and both are powers of two.
BLOCK = 512
#: Strings between white space that a task remembers the tokens of, and the longest such string.
REMEMBERED, LONGEST = 400_000, 64
#: Rows of a batch of pieces.
ROWS = 50_000
#: How the names of special tokens begin.
SPECIAL = "<|"

SPACE, OTHER = re.compile("[ \t\r\n]+"), re.compile("[\x1c-\x1f]")
#: ASCII and Latin letters without marks of their own, and how the tokenizer cuts them once they are lower case.
PLAIN = re.compile("[ \t\r\n!-~\u00c0-\u024f]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def read_vocabulary(path: str = VOCABULARY) -> str:
    """The text of a tokenizer file, of a fixed size."""
    with open(path, encoding="utf-8") as lines:
        return lines.read()


class Encoder:
    """From texts to their tokens, as 16-bit little-endian numbers.

    The tokenizer drops white space and merges nothing across it, so the strings between white space are
    encoded by themselves, and each of them once while it is remembered. Of those in plain Latin letters
    (``PLAIN``) also the pieces are remembered, as the tokenizer cuts them before it merges; others it
    encodes as a whole.
    """

    def __init__(self, vocabulary: str) -> None:
        self.whole = Tokenizer.from_str(vocabulary)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("tokens must be 16-bit numbers")
        self.bytes = byte_letters()
        self.merge = self.whole.model.tokenize
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        plain = PLAIN.fullmatch(text) is not None and SPECIAL not in text
        if plain:
            text, encode = text.lower(), self._plain
        else:
            encode = self._word
        # Python's own white space holds four characters that are none for the tokenizer.
        words = SPACE.split(text) if OTHER.search(text) else text.split()
        known = self.words
        new = {word for word in words if word not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        once = {}
        for word in new:
            (known if len(word) <= LONGEST else once)[word] = encode(word)
        if once:
            return b"".join(known.get(word) or once.get(word, b"") for word in words)
        return b"".join(map(known.__getitem__, words))

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and SPECIAL not in word:
            return self._plain(word.lower())
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _plain(self, word: str) -> bytes:
        return self._piece(word) if word.isalpha() else b"".join(map(self._piece, PIECES.findall(word)))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            letters = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
            found = [token.id for token in self.merge(letters)]
            ids = struct.pack(f"<{len(found)}H", *found)
            if len(piece) <= LONGEST:
                self.pieces[piece] = ids
        return ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte before merging: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in set(seen)]
    return {byte: chr(byte) for byte in seen} | {byte: chr(256 + n) for n, byte in enumerate(rest)}


def tokenised(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, queue, part, before, n, ids: before counts the queue's tokens in earlier rows of the part."""
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end, part = Encoder(sent.value), np.array([END], "<u2").tobytes(), TaskContext.get().partitionId()
        done: Counter[str] = Counter()
        for batch in batches:
            ids = [encoded(text or "") + end for text in batch["text"].to_pylist()]
            sizes, before = [len(one) // 2 for one in ids], []
            for queue, n in zip(batch["queue"].to_pylist(), sizes, strict=True):
                before.append(done[queue])
                done[queue] += n
            numbers = [pa.array(column, pa.int64()) for column in ([part] * len(ids), before, sizes)]
            columns = [batch["doc_id"], batch["queue"], *numbers, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue")
    rows = documents.select("doc_id", queue, "text")
    return bucketed(rows.mapInArrow(encode, TOKENISED), "part", "tokens")


NAMES = ["doc_id", "queue", "part", "before", "n", "ids"]
TOKENISED = "doc_id long, queue string, part long, before long, n long, ids binary"


def blocks(start: int, end: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, its size, place in it, tokens) of what a stretch of a queue of so many tokens covers."""
    whole = total // BLOCK
    while start < end:
        block, at, size = start // BLOCK, start % BLOCK, BLOCK
        if block >= whole:
            # The rest of the queue: a block for every bit of its size, the largest first.
            edge, block, size = whole * BLOCK, whole, BLOCK // 2
            while not (total & size and start < edge + size):
                if total & size:
                    edge, block = edge + size, block + 1
                size //= 2
            at = start - edge
        taken = min(end - start, size - at)
        yield block, size, at, taken
        start += taken


def sliced(rows: DataFrame) -> DataFrame:
    """The pieces of (doc_id, queue, n, ids, place, total, share): each lies in one block of its queue."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            columns = (batch[name].to_pylist() for name in ("doc_id", "queue", "n", "place", "total", "share"))
            for *known, ids in zip(*columns, batch["ids"], strict=True):
                doc_id, queue, n, place, total, share = known
                words = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4").view(np.uint8)
                done = 0
                for block, size, at, taken in blocks(place, place + n, total):
                    crc = zlib.crc32(words[4 * done : 4 * (done + taken)])
                    out.append((doc_id, done, taken, crc, n, queue, block, size, at, total, share))
                    done += taken
                if len(out) >= ROWS:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return rows.mapInArrow(cut, ", ".join(f"{name} {'string' if name == 'queue' else 'long'}" for name in PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "queue", "block", "size", "at", "total", "share"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PIECE)
    kinds = [pa.string() if name == "queue" else pa.int64() for name in PIECE]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECE)


def placed(tokens: DataFrame, weights: Mapping[str | None, int] | None) -> tuple[DataFrame, int]:
    """part, offsets: for each queue of a part the tokens in earlier parts, all its tokens and its share; all shares."""
    spark = tokens.sparkSession
    held = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "queues")
    totals = held.groupBy("queue").agg(F.sum("n").alias("total"))
    if weights is None:
        totals = totals.withColumn("share", F.col("total"))
    else:
        if not weights or any(w != int(w) or w <= 0 for w in weights.values()):
            raise ValueError("weights must be positive whole numbers")
        given = [("" if source is None else f"={source}", int(w)) for source, w in weights.items()]
        totals = totals.join(spark.createDataFrame(given, "queue string, share long"), "queue", "left")
    whole = totals.agg(F.sum("share")).first()[0] or 0
    before = ordered_scan(held, ["queue"], ["part"], sums={"upto": "n"})
    offsets = before.join(totals, "queue").select(
        "part", F.struct("queue", F.struct((F.col("upto") - F.col("n")).alias("earlier"), "total", "share").alias("at")).alias("entry")
    )
    return offsets.groupBy("part").agg(F.map_from_entries(F.collect_list("entry")).alias("offsets")), whole


def packed(documents: DataFrame, weights: Mapping[str | None, int] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document: its tokens, and the sequence and the offset they stand at."""
    tokens = tokenised(documents, vocabulary)
    offsets, whole = placed(tokens, weights)
    # Every part's rows lie in one bucket, so only the offsets, a row for each part, are exchanged.
    known = tokens.join(offsets.hint("shuffle_hash"), "part").withColumn("at", F.col("offsets")[F.col("queue")])
    place = (F.col("at.earlier") + F.col("before")).alias("place")
    pieces = stored(sliced(known.select("doc_id", "queue", "n", "ids", place, "at.total", "at.share")), "pieces")

    reached = (F.col("block") + 1).cast("decimal(19,0)") * F.lit(BLOCK * whole).cast("decimal(30,0)")
    quantum = F.col("share").cast("decimal(19,0)") * F.lit(WINDOW).cast("decimal(10,0)")
    heads = pieces.where("at = 0").select(
        F.lit(0).alias("stream"), "queue", "block", "size", (BLOCK - F.col("size")).alias("less"), reached.alias("reached"),
        quantum.alias("quantum"),
    )
    # Whole blocks by round and queue, then the smaller ones by size; queues without a share have no round.
    turn = F.when(F.col("less") == 0, F.expr("(reached + quantum - 1) div quantum"))
    heads = heads.withColumn("turn", turn).withColumn("late", F.col("turn").isNull())
    scanned = ordered_scan(heads, ["stream"], ["less", "late", "turn", "queue", "block"], sums={"upto": "size"})
    starts = scanned.select("queue", "block", (F.col("upto") - F.col("size")).alias("from"))
    found = pieces.join(starts, ["queue", "block"]).withColumn("position", F.col("from") + F.col("at"))
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr(f"position div {WINDOW}").alias("sequence_id"), (F.col("position") % WINDOW).alias("offset"),
    )

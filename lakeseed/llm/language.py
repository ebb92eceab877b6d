"""Language identification with bit-sliced Bloom filters over letter n-grams.

Learning counts the letter 3-grams of every labelled text per language, and a language holds all of its
own; those are also typical of it whose share is no less than ``LEAST`` of their share in any other language.
All languages share one Bloom filter whose rows are bit masks with two bits for each language, for its n-grams
and its typical ones: the AND of a 3-gram's ``HASHES`` rows is the set of languages that hold it. A text sums
these bits over all its 3-grams; each share of hits is corrected for the share that chance would give (its
rows' fill to the power of ``HASHES``), and the largest mean of a language's two shares decides. Ties go to the
language that comes first by name.

A null text, or one without a letter, is ``und`` with score 0. Texts whose 3-grams no language holds get
the commonest learned language with score 0. Rows without a label teach nothing; without any label every
text is ``und``. Texts are read whole in pieces; repeated rows count as often as they occur; other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.workspace import stored

LEAST = 0.25
#: Rows of the filter at least, and for each n-gram of the largest language; at most 18 % of its bits are set.
ROWS = 1 << 17
ROWS_PER_GRAM = 16
HASHES = 3
PIECE = 1 << 19
UNKNOWN = "und"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Packed 3-grams around letters, in pieces; texts are padded with blanks."""
    for at in range(0, len(text), PIECE):
        piece = f" {text[at : at + PIECE]} ".encode("utf-32-le", "surrogatepass")
        points = table[np.frombuffer(piece, np.uint32)].astype(np.uint64)
        packed = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        yield packed[points[1:-1] != 32]


def places(packed: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    """The rows of the filter that each n-gram is hashed to."""
    mixed, out = packed * MULTIPLIER, []
    for _ in range(HASHES):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MULTIPLIER
        out.append((mixed >> np.uint64(65 - rows.bit_length())).astype(np.int64))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    commonest: str
    slices: list[np.ndarray]
    chance: np.ndarray

    @classmethod
    def of(cls, sets: dict[str, np.ndarray], commonest: str, rows: int = ROWS) -> Model:
        languages = sorted(sets)
        slices = [np.zeros(rows, np.uint64) for _ in range(0, len(languages), 64)]
        for number, language in enumerate(languages):
            for place in places(sets[language], rows):
                slices[number // 64][place] |= np.uint64(1 << number % 64)
        return cls.from_slices(languages, commonest, slices, len(languages))

    @classmethod
    def from_slices(cls, languages: list[str], commonest: str, slices: list[np.ndarray], bits: int) -> Model:
        fill = [((slices[n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean() for n in range(bits)]
        return cls(languages, commonest, slices, np.array(fill) ** HASHES)

    def counts(self, packed: np.ndarray) -> np.ndarray:
        """How many of the n-grams each bit holds: those of all languages, then their typical ones."""
        where = places(packed, len(self.slices[0])) if self.slices else []
        masks = [s[where[0]] & s[where[1]] & s[where[2]] for s in self.slices]
        return np.array(
            [np.count_nonzero(masks[n // 64] & np.uint64(1 << n % 64)) for n in range(len(self.chance))], np.int64
        )

    def predict(self, text: str | None, table: np.ndarray) -> tuple[str, float]:
        n, hits = 0, np.zeros(len(self.chance), np.int64)
        for packed in grams(text or "", table):
            n += len(packed)
            hits += self.counts(packed)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        share = np.clip((hits / n - self.chance) / (1 - self.chance), 0, 1)
        share = share.reshape(-1, len(self.languages)).mean(axis=0)
        best = int(share.argmax())
        return (self.languages[best], float(share[best])) if share[best] > 0 else (self.commonest, 0.0)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (text, lang)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = letters()
        for batch in batches:
            for language, texts in batch.groupby("lang").text:
                joined = "  ".join(texts)
                parts = [np.unique(packed, return_counts=True) for packed in grams(joined, table)]
                for found, n in parts:
                    yield pd.DataFrame({"lang": language, "gram": found.astype(np.int64), "n": n})

    usable = rows.select("text", "lang").where("text is not null and lang is not null")
    return usable.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def set_bits(counts: DataFrame, languages: list[str], rows: int) -> DataFrame:
    """slice, place, mask for every row of the filter with bits, over all (lang, gram, typical)."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {language: n for n, language in enumerate(languages)}
        for batch in batches:
            number = batch.lang.map(numbers).to_numpy(np.int64)
            number = np.concatenate([number, number[batch.typical.to_numpy(bool)] + len(languages)])
            gram = np.concatenate([batch.gram, batch.gram[batch.typical]]).astype(np.uint64)
            mask = (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
            for place in places(gram, rows):
                yield pd.DataFrame({"slice": number // 64, "place": place, "mask": mask})

    found = counts.select("lang", "gram", "typical").mapInPandas(bits, "slice long, place long, mask long")
    return found.groupBy("slice", "place").agg(F.bit_or("mask").alias("mask"))


def learn(rows: DataFrame) -> Model:
    """A model from all rows of (text, lang); the driver gets the languages and the rows of the filter."""
    counts = stored(gram_counts(rows), "grams")
    known = counts.groupBy("lang").agg(F.sum("n").alias("mass"), F.count("*").alias("grams")).collect()
    if not known:
        return Model.of({}, UNKNOWN)
    languages = sorted(row.lang for row in known)
    size = max(ROWS, 1 << (ROWS_PER_GRAM * max(row.grams for row in known) - 1).bit_length())
    slices = [np.zeros(size, np.uint64) for _ in range(0, 2 * len(languages), 64)]
    share = F.col("n") / F.col("mass")
    shares = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("mass")), "lang").withColumn("share", share)
    typical = F.col("share") >= LEAST * F.max("share").over(Window.partitionBy("gram"))
    held = set_bits(shares.withColumn("typical", typical), languages, size).toPandas()
    for number, part in held.groupby("slice"):
        slices[number][part.place.to_numpy()] = part["mask"].to_numpy(np.int64).view(np.uint64)
    return Model.from_slices(languages, min(known, key=lambda row: (-row.mass, row.lang)).lang, slices, 2 * len(languages))


def predicted(text: Column, model: Model, spark) -> Column:
    """A struct of lang and score for each text."""
    shared = spark.sparkContext.broadcast((model.languages, model.commonest, model.slices, model.chance))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, known = letters(), Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([known.predict(t, table) for t in texts], columns=["lang", "score"])

    return predict(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(documents: DataFrame) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    model = learn(documents.where(~held_out(F.col("doc_id"))))
    found = predicted(F.col("text"), model, documents.sparkSession)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def accepted(documents: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    model = learn(documents.where(~held_out(documents["doc_id"])))
    found = predicted(documents["text"], model, documents.sparkSession)
    return documents.where(found["lang"] != UNKNOWN)

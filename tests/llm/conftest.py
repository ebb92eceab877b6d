"""Frames of documents for the tests of this folder."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ["n_words", "found", "grp", "x", "class", "n", "doc", "mark", "key", "spans", "_rank", "mix_slot", "label", "score", "node"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (id, text, language, source) rows, with extra columns that clash on request."""

    def build(rows, clash: bool = False):
        rows = [(*row, *("en", "src0")[len(row) - 2 :]) if len(row) < 4 else row for row in rows]
        frame = spark.createDataFrame([(*row, len(row[1] or "")) for row in rows], SCHEMA)
        return frame.selectExpr("*", *(f"'?' AS {name}" for name in CLASHING)) if clash else frame

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977}" for i in range(60_000))
    return [
        (1, None, "en", "a"),
        (None, "a text without an id that says some more words than ten in all", "en", "a"),
        (None, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "b"),
        (4, words, "en", None),
        (5, "the same text twice with the same words in it and then some more", "de", "b"),
        (5, "the same text twice with the same words in it and then some more", "de", "b"),
        (6, "the same text twice with the same words in it and then some more", "de", "b"),
        (6, "one id with another text of a few words that nobody else has at all", "fr", "b"),
        (7, "x" * 100_000, "en", "a"),
        (8, "\U0001f600 é ß 1234", "de", "a"),
    ]

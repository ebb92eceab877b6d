"""Packing against a plain deficit round-robin and the plain tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeseed.llm import packing as p

MODEL = Tokenizer.from_file(p.VOCABULARY)


def ids_of(text):
    return [*MODEL.encode(text or "", add_special_tokens=False).ids, 1]


#: Letters with and without marks, signs, numbers, and every kind of white space.
CHARACTERS = [*"aBsß×_'1,²ª。Σσİƛɐ", "\u0301", "\u0307", "ll", "<|endoftext|>", *" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b\u3000"]
ENCODE = p.Encoder(p.read_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(CHARACTERS), max_size=30).map("".join))
def test_tokens_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODE(text), "<u2").tolist() == ids_of(text)[:-1]


def test_long_strings_and_forgetting(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 3)
    encode = p.Encoder(p.read_vocabulary())
    for text in ("x" * 3000 + " and more", "a b c d e f", "<|endoftext|> a", "", "a  b"):
        assert np.frombuffer(encode(text), "<u2").tolist() == ids_of(text)[:-1]


def checked(frame, rows, weights=None):
    """The pieces, after their tokens and places have been checked."""
    pieces = p.packed(frame, weights).collect()
    texts = defaultdict(list)
    for row in rows:
        texts[row[0]].append(ids_of(row[1]))
    covered = defaultdict(int)
    for piece in pieces:
        crcs = [
            zlib.crc32(np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes())
            for ids in texts[piece.doc_id] if len(ids) == piece.doc_tokens
        ]
        assert piece.ids_crc32 in crcs and piece.length > 0
        covered[piece.doc_id] += piece.length
    assert covered == {i: sum(map(len, t)) for i, t in texts.items()}
    places = sorted((x.sequence_id * p.WINDOW + x.offset, x.length) for x in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert not places or places[0][0] == 0
    assert all(x.offset + x.length <= p.WINDOW for x in pieces)
    return pieces


def served(pieces, sources):
    """Whole blocks in the order they stand in, by source."""
    blocks = defaultdict(list)
    for x in pieces:
        blocks[(x.sequence_id * p.WINDOW + x.offset) // p.BLOCK].append((x.length, sources[x.doc_id]))
    order = []
    for _, parts in sorted(blocks.items()):
        if sum(n for n, _ in parts) == p.BLOCK and len({s for _, s in parts}) == 1:
            order.append(parts[0][1])
    return order


def round_robin(tokens, weights):
    """Plain deficit round-robin over blocks."""
    left = {s: n // p.BLOCK for s, n in tokens.items()}
    deficit, order, all_ = dict.fromkeys(tokens, Fraction(0)), [], sum(weights.values())
    while any(left.values()):
        for s in sorted(tokens):
            deficit[s] += Fraction(weights[s] * p.WINDOW, all_)
            while left[s] and deficit[s] >= p.BLOCK:
                order.append(s)
                deficit[s], left[s] = deficit[s] - p.BLOCK, left[s] - 1
    return order


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 2}])
def test_blocks_are_served_by_deficits(documents, monkeypatch, weights):
    monkeypatch.setattr(p, "BLOCK", 8)
    monkeypatch.setattr(p, "WINDOW", 32)
    rng = random.Random(3)
    rows = [(n, " ".join(rng.choices(["the", "cat", "of", "and"], k=rng.randint(0, 60))), "en", rng.choice("aaabbc")) for n in range(200)]
    pieces = checked(documents(rows).repartition(5), rows, weights)
    sources = {r[0]: r[3] for r in rows}
    tokens = defaultdict(int)
    for row in rows:
        tokens[row[3]] += len(ids_of(row[1]))
    order = served(pieces, sources)
    want = round_robin(tokens, weights or tokens)
    assert order[: len(want)] == want
    # Only the very last window is not full.
    assert max(x.sequence_id for x in pieces) == (sum(tokens.values()) - 1) // 32
    # While no queue has run out, each is less than a block behind its share after every round.
    shares = weights or tokens
    done, rounds = dict.fromkeys(tokens, 0), min(t * sum(shares.values()) // (32 * shares[s]) for s, t in tokens.items())
    at = iter(order)
    for turn in range(1, rounds + 1):
        quanta = {s: Fraction(32 * turn * shares[s], sum(shares.values())) for s in tokens}
        for _ in range(sum(int(q // 8) for q in quanta.values()) - sum(done.values()) // 8):
            done[next(at)] += 8
        assert all(0 <= quanta[s] - done[s] < 8 for s in tokens)


def test_queues_without_a_weight_come_last(documents):
    rows = [(n, "the cat " * 400, "en", "ab"[n % 2]) for n in range(8)]
    pieces = checked(documents(rows), rows, {"b": 1})
    order = served(pieces, {n: "ab"[n % 2] for n in range(8)})
    assert order == sorted(order, reverse=True)
    for wrong in ({}, {"a": 0}, {"a": -1}, {"a": 0.5}):
        with pytest.raises(ValueError):
            p.packed(documents(rows), wrong)


def test_blocks_of_a_stretch():
    for total in (0, 1, 511, 512, 1023, 5000):
        found = list(p.blocks(0, total, total))
        assert [at for _, _, at, _ in found] == [0] * len(found)
        assert sum(n for *_, n in found) == total and all(size == n for _, size, _, n in found)
        assert [b for b, *_ in found] == list(range(len(found)))
        by_one = [next(p.blocks(n, n + 1, total)) for n in range(total)]
        assert [(b, at) for b, _, at, _ in by_one] == [(b, k) for b, size, _, _ in found for k in range(size)]


def test_odd_rows_and_empty_table(documents, odd_rows):
    checked(documents(odd_rows, clash=True), odd_rows)
    assert p.packed(documents([])).collect() == []

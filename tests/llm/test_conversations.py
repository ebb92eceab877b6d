"""The prefix trie against a plain one, with small units and shards so that every kind of boundary occurs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakeseed.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ["shard", "kind", "path", "depth", "n", "mark", "words", "at", "own", "known", "place", "segment"]


def frame(spark, rows, clash=False):
    made = spark.createDataFrame(rows, SCHEMA)
    return made.selectExpr("*", *(f"'?' AS {name}" for name in CLASHING)) if clash else made


def plain(rows):
    """Every node by definition; rows of a conversation with equal turns must be equal."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        built[conv] = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv in sorted(built):
        for d in range(len(built[conv]) + 1):
            members[built[conv][:d]].append(conv)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
    return sorted(
        (
            ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), len(kids[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(str(i) for i in ids if built[i] == path).encode()).hexdigest(),
        )
        for path, ids in members.items()
    )


def found(frame):
    return sorted(tuple(row) for row in c.nodes(frame).collect())


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(5 * convs), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn, rng.choice(["a", "b"]), rng.choice(["", "x", "x y", "z z z"][: rng.choice([1, 2, 4])])))
    return rows


@pytest.mark.parametrize("segment, shard, longest", [(64, 10_000, 6), (3, 4, 14), (1, 1, 4), (2, 7, 30)])
def test_like_a_plain_trie(spark, monkeypatch, segment, shard, longest):
    for name, value in (("SEGMENT", segment), ("SHARD", shard), ("IDS", 2)):
        monkeypatch.setattr(c, name, value)
    rows = made(segment + shard, 60, longest)
    assert found(frame(spark, rows)) == plain(rows)


def test_copies_and_a_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(c, "SHARD", 16)
    monkeypatch.setattr(c, "IDS", 3)
    rows = [(20 * n, t, "user", f"turn {t}") for n in range(90) for t in range(1 + n % 3)]
    rows += [(20 * n, t, "user", "turn 0" if not t else f"own {n}") for n in range(90, 150) for t in range(3)]
    assert found(frame(spark, rows)) == plain(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 8)
    rows = [(40, t, "user", str(t)) for t in range(500)] + [(60, t, "user", str(t)) for t in range(300)]
    rows += [(n, 0, "user", "0") for n in range(61, 79)]
    assert found(frame(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"),
        (0, None, None, None),
        (0, 3, "user", "ab"),
        (0, 3, "user", "ab"),
        (1, 0, "usera", "b"),
        (1, 1, "user", " \n\t "),
        (2, 5, "", ""),
        (3, 1, "user", "word " * 50_000),
        (3, 2, "user", None),
        (41, 0, "x", "alone"),
        (-1, 0, "x", "below zero"),
    ]
    assert found(frame(spark, rows[:-1], clash=True)) == plain(rows[:-1])
    assert c.nodes(frame(spark, rows)).count() > 0
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, 1, "a", "b")])) == []


def test_role_and_text_are_told_apart(spark):
    rows = [(0, 0, "ab", "c"), (20, 0, "a", "bc"), (40, 0, "", "abc")]
    assert found(frame(spark, rows)) == plain(rows)


def test_tree_is_balanced_by_medians():
    trie = c.Trie()
    for n in c.median_order(1000):
        trie.insert([n, 7])
    at, steps = trie.root, 0
    while at >= 0:
        at, steps = trie.more[at], steps + 1
    assert steps <= 11
    assert sorted(trie.walk()) == list(range(2000))
    assert sorted(c.median_order(17)) == list(range(17))

"""Divergences of sources against plain sums, with small ranges and tiles."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeseed.llm import divergence as d


def plain(rows, least=None, top=None):
    least, top = least or d.MIN_DOCUMENTS, top or d.TOP
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang, source in counts:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(mine.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept))

        pairs = [(-sum(abs(p(mine[source], t) - p(c, t)) for t in kept), s) for s, c in mine.items() if s != source]
        apart = [(p(whole, t) - p(mine[source], t), t) for t in kept if mine[source][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in apart if x[0] < 0)[:top])):
            out += [(lang, source, part, item, -value, n + 1) for n, (value, item) in enumerate(found)]
    return sorted(out)


def found(frame):
    return sorted(tuple(row) for row in d.audited(frame).collect())


@pytest.mark.parametrize("span, tile", [(4096, 64), (3, 2), (1, 1)])
def test_like_plain_sums(documents, monkeypatch, span, tile):
    for name, value in (("RANGE", span), ("TILE", tile), ("MIN_DOCUMENTS", 3), ("TOP", 4), ("HELD", 40)):
        monkeypatch.setattr(d, name, value)
    rng = random.Random(span)
    words = [f"{a}{b}" for a in "abcÄß" for b in "xyZ"]
    rows = [
        (n, " ".join(rng.choices(words[: rng.choice([4, 15])], k=rng.randint(0, 12))), rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}")
        for n in range(120)
    ]
    assert found(documents(rows, clash=True)) == plain(rows, 3, 4)


def test_hot_source_and_groups_without_terms(documents, monkeypatch):
    monkeypatch.setattr(d, "MIN_DOCUMENTS", 5)
    rows = [(n, f"common word{n % 7} common", "en", "hot" if n % 3 else "b") for n in range(60)]
    rows += [(100, None, "en", "none"), (101, "1 2 3", "en", None), (102, "one text", "fr", "x"), (103, "", "fr", "y")]
    assert found(documents(rows)) == plain(rows, 5)


def test_odd_rows_and_empty_table(documents, odd_rows, monkeypatch):
    assert found(documents(odd_rows, clash=True)) == plain(odd_rows)
    monkeypatch.setattr(d, "MIN_DOCUMENTS", 1)
    assert found(documents(odd_rows, clash=True)) == plain(odd_rows, 1)
    assert found(documents([])) == []


def test_runs_meet_at_their_bounds():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 3, (4, 200))
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert d.pair_sums(columns, pairs).tolist() == [int(np.abs(columns[a] - columns[b]).sum()) for a, b in pairs]
    ordered, starts = d.runs(columns)
    assert sorted(map(tuple, ordered.T)) == sorted(map(tuple, columns.T))
    assert len(starts[-1]) == 3

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest

from lakeseed.llm import repeats as r


def plain(docs):
    """Every string of 100 bytes looked up among all that start earlier."""
    first = {}
    order = sorted({(i if i is not None else r.LEAST_ID, t or "") for i, t, *_ in docs})
    for doc, text in order:
        raw = text.encode()
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            first[s] = min(first.get(s, (doc, k)), (doc, k))
    out = []
    for i, text, *_ in docs:
        raw = (text or "").encode()
        doc = i if i is not None else r.LEAST_ID
        covered = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] < (doc, k):
                covered[k : k + 100] = b"\x01" * 100
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        n = sum(c and (not k or not covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, len(raw), sum(covered), n, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(x) for x in frame.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(n))

    passages = [words(n) for n in (18, 22, 40, 90, 400)]
    docs = []
    for i in range(120):
        parts = [words(int(rng.integers(1, 60))) for _ in range(rng.integers(1, 4))]
        parts += [passages[k] for k in rng.integers(0, 5, rng.integers(0, 3))]
        cut = passages[4][int(rng.integers(0, 200)) :]
        parts.append(cut[: int(rng.integers(0, 400))])
        docs.append((i * 3 % 120, " ".join(rng.permutation(parts))))
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    edited = docs[7][1]
    for i in range(40):
        at = int(rng.integers(0, len(edited)))
        docs.append((500 + i, edited[:at] + "#" + edited[at + 1 :]))
    docs += [(600, "ab" * 300), (601, "ab" * 300), (602, "x" * 99), (603, "x" * 99), (604, "x" * 100), (605, "y" + "x" * 100), (606, "z" * 500)]
    order = rng.permutation(len(docs))
    return [docs[i] for i in order]


@pytest.mark.parametrize("batches", [1, 4])
def test_like_plain(documents, corpus, batches):
    assert rows(r.measured(documents(corpus, clash=True), batches)) == plain(corpus)


def test_parts_change_nothing(documents, corpus, monkeypatch):
    monkeypatch.setattr(r, "PART", 3)
    monkeypatch.setattr(r, "SENT", 0)
    monkeypatch.setattr(r, "CHUNK", 300)
    assert rows(r.measured(documents(corpus))) == plain(corpus)


def test_levels_merge_geometrically(documents, corpus):
    family = r.Family()
    texts = r.texts_of(documents(corpus))
    for k in range(6):
        family.add(texts.where(f"pmod(doc, 6) = {k}"))
        sizes = [n for n, _ in family.levels]
        assert all(2 * b < a for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    assert len(family.levels) <= 4
    assert sum(n for n, _ in family.levels) == sum(level.count() for _, level in family.levels)


def test_batches_in_any_order(documents, corpus):
    """What starts earlier is judged by ids, not by the order in which batches come."""
    texts = r.texts_of(documents(corpus))
    family = r.Family()
    for k in (2, 0, 1):
        family.add(texts.where(f"pmod(doc, 3) = {k}"))
    covered = {(x.doc, x.mark): x.covered for x in r.covers(texts, family).collect()}
    want = {i: removed for i, _, removed, *_ in plain(corpus)}
    for x in texts.collect():
        assert r.kept_bytes(x.text, covered.get((x.doc, x.mark)))[1] == want[x.doc]


def test_left_texts(documents):
    text = "the quick brown fox jumps over the lazy dog while nobody looks at the clock on the wall of the house ünd so"
    left = {x.doc_id: x.text for x in r.without_repeats(documents([(1, text), (2, "A " + text + " Z"), (3, None)])).collect()}
    assert left == {1: text, 2: "A  Z", 3: None}


def test_odd_rows_and_empty_table(documents, odd_rows):
    rows_ = [x for x in odd_rows if len(x[1] or "") < 1000] + [(7, "x" * 3000, "en", "a")]
    assert rows(r.measured(documents(rows_, clash=True))) == plain(rows_)
    assert r.measured(documents(odd_rows)).count() == len(odd_rows)
    assert r.measured(documents([])).count() == 0

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseed.llm import outliers as o


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x85\x1c\xa0", max_size=80))
def test_statistics_like_plain(text):
    assert o.statistics(text) == plain(text)


def test_repeats_with_many_different_words():
    words = [b"%d" % i for i in range(9000)]
    assert o.repeated_words(words) == 0
    assert o.repeated_words([*words, *words[100:106], b"x"]) == 12


def test_block_estimate_ignores_outliers():
    rng = np.random.default_rng(3)
    clean = rng.standard_normal((900, 5)) * 0.5 + 2
    dirty = rng.standard_normal((150, 5)) * 0.1 + 9
    _, centre, cover = o.block_estimate(np.concatenate([clean, dirty]))
    assert np.abs(centre - 2).max() < 0.1
    assert o.distances(dirty, centre, cover).min() > o.CUTOFF


def text(rng, junk=False):
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(rng.integers(40, 120))]
    return " ".join(w + "%%%##" * junk for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = [(i, text(rng), "en", "a" if i % 3 else "b") for i in range(700)]
    return rows + [(1000 + i, text(rng, True), "en", "a") for i in range(30)]


def test_junk_is_rejected_and_clean_documents_stay(documents, corpus):
    found = {r.doc_id: r for r in o.judged(documents(corpus, clash=True)).collect()}
    assert len(found) == len(corpus)
    assert not any(found[i].kept for i in range(1000, 1030))
    assert sum(found[i].kept for i in range(700)) >= 698
    for doc_id, whole, *_ in corpus:
        r = found[doc_id]
        n_words, chars, symbols, _, lines, repeats = plain(whole)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, lines, repeats)
        assert r.base_failed == (n_words < 10 or 100 * repeats > 20 * n_words)


def test_estimate_like_exact_steps(spark):
    """The estimate by distance classes stays near exact concentration steps over all vectors."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((5000, 5)), rng.standard_normal((600, 5)) + 8])
    frame = spark.createDataFrame([("g", len(x), v.tolist()) for v in x], "grp string, n_grp long, x array<double>")
    model = o.estimates(frame).first().model
    centre, cover = o.unpacked(np.array(model))
    _, exact, exact_cover = o.block_estimate(x)
    assert np.abs(centre - exact).max() < 0.08
    assert abs(np.linalg.slogdet(cover)[1] - np.linalg.slogdet(exact_cover)[1]) < 0.3


def plain_mcd(x, rng):
    """The minimum covariance determinant from many random starts, each step over all rows."""
    h, best = int(o.CORE * len(x)), None
    for _ in range(60):
        near = rng.choice(len(x), 6, replace=False)
        for _ in range(60):
            centre = x[near].mean(axis=0)
            cover = np.cov(x[near].T, bias=True) + np.diag(o.FLOOR**2)
            far = [(v - centre) @ np.linalg.inv(cover) @ (v - centre) for v in x]
            near = np.argsort(far)[:h]
        determinant = np.linalg.det(cover)
        best = (determinant, np.array(far)) if best is None or determinant < best[0] else best
    return best


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_verdicts_like_plain_mcd(spark, monkeypatch, block_rows):
    """Correlated vectors with two clusters of outliers: the same rows are far, in one block and in many."""
    monkeypatch.setattr(o, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(21)
    x = rng.standard_normal((260, 5)) @ np.triu(np.full((5, 5), 0.4))
    x = np.concatenate([x, rng.standard_normal((25, 5)) * 0.2 + [6, -6, 6, -6, 6], rng.standard_normal((15, 5)) * 0.2 - 9])
    frame = spark.createDataFrame([("g", len(x), v.tolist()) for v in x], "grp string, n_grp long, x array<double>")
    centre, cover = o.unpacked(np.array(o.estimates(frame).first().model))
    determinant, far = plain_mcd(x, rng)
    assert np.log(determinant) - np.linalg.slogdet(cover)[1] == pytest.approx(0, abs=0.15)
    found = o.distances(x, centre, cover) > o.CUTOFF
    assert found[260:].all() and not found[:260].any()
    assert (found == (far > o.CUTOFF)).all()


def test_small_groups_are_judged_by_their_language(documents, corpus):
    """Sources of one text each, and a language of three: junk goes, clean texts stay."""
    rng = np.random.default_rng(6)
    lone = [(2000 + i, text(rng, i % 2 == 1), "en", f"host{i}") for i in range(12)]
    few = [(3000 + i, text(rng), "xx", "a") for i in range(3)]
    found = {r.doc_id: r.kept for r in o.judged(documents(corpus + lone + few)).collect()}
    assert [found[2000 + i] for i in range(12)] == [i % 2 == 0 for i in range(12)]
    assert all(found[3000 + i] for i in range(3))


def test_odd_rows_and_empty_table(documents, odd_rows):
    found = o.judged(documents(odd_rows, clash=True)).collect()
    assert len(found) == len(odd_rows)
    assert {r.doc_id for r in found if r.base_failed} >= {1, 2, 3, 7, 8}
    assert o.judged(documents([])).count() == 0

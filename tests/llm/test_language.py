from __future__ import annotations

import numpy as np
import pytest

from lakeseed.llm import language as g

WORDS = {
    "en": "the and that with from this have were which there".split(),
    "de": "der und nicht mit einer wurde über zwischen schon größe".split(),
    "es": "el los para niño está como pero también más año".split(),
}


def texts(lang, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def corpus():
    return [(i, texts(lang, i), lang, "s") for i, lang in enumerate(["en", "de", "es"] * 30)]


def test_held_out_accuracy(documents, corpus):
    found = {r.doc_id: r for r in g.identified(documents(corpus, clash=True)).collect()}
    assert len(found) == len(corpus)
    held = [i for i, *_ in corpus if found[i].held_out]
    assert held and all(found[i].lang_pred == corpus[i][2] for i in held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_rows_teach_nothing(documents, corpus):
    before = {r.doc_id: (r.held_out, r.lang_pred) for r in g.identified(documents(corpus)).collect()}
    wrong = [(i, t, "xx" if before[i][0] else lang, s) for i, t, lang, s in corpus]
    after = {r.doc_id: (r.held_out, r.lang_pred) for r in g.identified(documents(wrong)).collect()}
    assert before == after


def test_counts_like_plain(documents, corpus):
    table = g.letters()
    plain = {}
    for _, text, lang, _ in corpus:
        padded = f" {text.lower()} "
        padded = "".join(c if c.isalpha() else " " for c in padded)
        for k in range(len(padded) - 2):
            if padded[k + 1] != " ":
                gram = sum(ord(c) << 21 * (2 - j) for j, c in enumerate(padded[k : k + 3]))
                plain[lang, gram] = plain.get((lang, gram), 0) + 1
    found = {(r.lang, r.gram): r.n for r in g.gram_counts(documents(corpus)).collect()}
    assert found == plain and table[ord("Ä")] == ord("ä") and table[ord("1")] == 32


def test_bit_slices_hold_their_sets_for_many_languages():
    rng = np.random.default_rng(1)
    sets = {f"l{i:03}": rng.integers(0, 1 << 60, 50).astype(np.uint64) for i in range(70)}
    model = g.Model.of(sets, "l000")
    assert len(model.slices) == 2
    for number, name in enumerate(model.languages):
        assert model.counts(sets[name])[number] == 50
    none = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    assert np.allclose(model.counts(none) / 20_000, model.chance, atol=0.005)


def many_letters(rng, n=400):
    """A text over 3,000 letters, nearly every 3-gram of which occurs once."""
    return "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, n))


def test_languages_of_many_letters_are_held_whole(spark, documents, corpus):
    rng = np.random.default_rng(3)
    long = [(1000 + i, many_letters(rng), "zh", "s") for i in range(60)]
    frame = documents(corpus + long)
    model = g.learn(frame)
    assert model.languages == ["de", "en", "es", "zh"] and model.chance.max() < 0.01
    table = g.letters()
    for _, text, *_ in long:
        packed = np.concatenate(list(g.grams(text, table)))
        assert model.counts(packed)[3] == len(packed)
        assert model.predict(text, table) == ("zh", 1.0)
    # New texts of its letters are few of the learned 3-grams, and are kept.
    new = [(2000 + i, many_letters(rng), None, "s") for i in range(20)]
    kept = {r.doc_id for r in g.accepted(documents(corpus + long + new)).collect()}
    assert kept >= {i for i, *_ in new}


def test_no_letter_and_odd_rows(documents, corpus, odd_rows):
    rows = [(100, None, "en", "s"), (101, "12 34 !", "en", "s"), (102, "é", None, "s"), (103, "the and", None, "s")]
    found = {r.doc_id: r for r in g.identified(documents(corpus + rows)).collect()}
    assert found[100].lang_pred == found[101].lang_pred == "und" and found[101].score == 0
    assert found[102].lang_pred != "und" and found[103].lang_pred == "en"
    assert g.identified(documents(odd_rows, clash=True)).count() == len(odd_rows)
    assert g.identified(documents([])).count() == 0
    unlabelled = documents([(1, "the and that", None, None)])
    assert [r.lang_pred for r in g.identified(unlabelled).collect()] == ["und"]


def test_long_text_is_read_whole(documents):
    table = g.letters()
    text = "ab " * (g.PIECE // 2)
    assert sum(map(len, g.grams(text, table))) >= 2 * (g.PIECE // 2)


def test_accepted_keeps_columns(documents, corpus):
    frame = documents([*corpus, (200, "?? 11", "en", "s"), (201, None, "en", "s")], clash=True)
    kept = g.accepted(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in corpus)


def test_letters_of_all_planes_are_letters(documents):
    rows = [(i, "an english text of some words", "en", "a") for i in range(8)] + [(100, chr(0x30000) + chr(0x31000), None, "a"), (101, "123", None, "a")]
    found = {r.doc_id: r.lang_pred for r in g.identified(documents(rows)).collect()}
    assert found[100] != "und" and found[101] == "und"

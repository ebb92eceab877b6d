from __future__ import annotations

import re
from hashlib import sha256

import pytest

from lakeseed.llm import decontaminate as d

ITEM = [f"w{i}" for i in range(30)]


def plain(docs, items):
    """Every window of every item looked for at every place."""

    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for doc_id, text in docs:
        found, hit, names = words(text), set(), set()
        for item_id, item in items:
            ws = words(item)
            k = min(13, len(ws))
            for p in range(len(ws) - k + 1 if k else 0):
                for at in range(len(found) - k + 1):
                    if found[at : at + k] == ws[p : p + k]:
                        hit.update(range(at, at + k))
                        names.update([] if item_id is None else [str(item_id)])
        digest = sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(found), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(ITEM)), (2, "Only four words here"), (3, None), (4, "--"), (10, " ".join(ITEM[5:20])), (None, "no id item")]
    return spark.createDataFrame(rows, "item_id long, text string")


DOCS = [
    (1, " ".join(ITEM[3:18])),
    (2, "before " + ", ".join(ITEM[:13]).upper() + " after"),
    (3, " ".join(ITEM[:12])),
    (4, "x " * 400 + "only FOUR words   here"),
    (5, "only four words here only four words here"),
    (6, "here is no id item at all"),
    (7, None),
    (8, ""),
    (8, ""),
    (9, " ".join(ITEM[:20]) + " ä " + " ".join(ITEM[10:30])),
]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_like_plain(spark, documents, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    assert rows(d.judged(documents(DOCS, clash=True), benchmark)) == plain(DOCS, items)


@pytest.mark.parametrize("size", [3, 15])
def test_blocks_change_nothing(documents, benchmark, size, monkeypatch):
    whole = rows(d.judged(documents(DOCS), benchmark))
    monkeypatch.setattr(d, "hits", lambda texts, bench, hits=d.hits: hits(texts, bench, size))
    assert rows(d.judged(documents(DOCS), benchmark)) == whole
    assert sorted(r.doc_id for r in d.clean(documents(DOCS), benchmark).collect()) == [3, 4, 7, 8, 8]


def test_clean_and_cut(documents, benchmark):
    frame = documents(DOCS, clash=True)
    kept = d.clean(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 8, 8]
    texts = {r.doc_id: r.text for r in d.without_spans(frame, benchmark).collect()}
    assert texts[2] == "before  after" and texts[7] is None and texts[3] == " ".join(ITEM[:12])


def test_odd_rows_and_empty_tables(documents, odd_rows, benchmark):
    assert d.judged(documents(odd_rows, clash=True), benchmark).count() == len(odd_rows)
    assert d.judged(documents([]), benchmark).count() == 0
    assert {r.n_hit for r in d.judged(documents(odd_rows), benchmark.limit(0)).collect()} == {0}

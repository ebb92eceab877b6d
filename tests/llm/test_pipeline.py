from __future__ import annotations

import corpus_pipeline
import pytest

from lakeseed.llm import queries
from lakeseed.workspace import stored
from tests.llm import test_decontaminate, test_jaccard, test_secrets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), "stage"))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_each_stage_like_a_plain_version(spark, stages):
    kept = [texts(frame) for frame in stages]
    assert set(kept[1]) == {i for i, t in kept[0].items() if t is not None and any(c.isalpha() for c in t)}
    assert set(kept[2]) == {c for _, _, c in test_jaccard.plain(list(kept[1].items()))}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    judged = test_decontaminate.plain(list(kept[2].items()), items)
    assert set(kept[3]) == {row[0] for row in judged if not row[-1]}
    secret = {i for i, t in kept[3].items() if test_secrets.plain_base(t)}
    assert set(kept[3]) - set(kept[4]) >= secret
    assert len(set(kept[3]) - set(kept[4]) - secret) <= 2
    assert kept[5] == kept[4]
    assert all(kept[n + 1].items() <= kept[n].items() for n in range(5))


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "mix_block", "mix_slot", "mix_place", "in_mix"]


def test_odd_documents_and_empty_table(spark, documents, odd_rows):
    for frame in (documents(odd_rows, clash=True), documents([])):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), "stage")
        assert docs.count() <= len(odd_rows)


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.CHECKS) <= set(queries.QUERIES)

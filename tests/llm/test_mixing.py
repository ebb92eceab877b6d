from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction
from math import isqrt, lcm

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseed.llm import mixing as m

WEIGHTS = st.lists(st.one_of(st.integers(0, 10**6), st.floats(0, 1)), min_size=1, max_size=30).filter(any)


def check_lag(weights, found):
    """Every slot has one source's next block, and no source is ever a block or more away from its share."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(w.denominator for w in exact))
    shares = [int(w * unit) for w in exact]
    total, done = sum(shares), [0] * len(weights)
    for at, (n, block, slot) in enumerate(found):
        assert slot == at and block == done[n]
        # A source is behind most just before one of its slots, and ahead most just after.
        assert abs(shares[n] * slot - done[n] * total) < total
        done[n] += 1
        assert abs(shares[n] * (slot + 1) - done[n] * total) < total
    assert all(abs(share * len(found) - n * total) < total for share, n in zip(shares, done, strict=True))


@settings(max_examples=150, deadline=None)
@given(WEIGHTS, st.integers(1, 80))
def test_every_source_is_less_than_a_block_from_its_share(weights, least):
    shares = m.whole(weights)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "STRETCH", least)
        patch.setattr(m, "SLOTS_PER_SOURCE", 1)
        size = m.stretch_size(shares, 600)
    check_lag(weights, list(m.schedule(shares, iter(range(600 // size)), size)))


def test_square_roots_over_a_thousand_stretches():
    weights = [n**0.5 for n in (1_001, 20_003, 3, 500_009)] + [0.9]
    shares = m.whole(weights)
    assert m.stretch_size(shares, 10**9) == 1024
    check_lag(weights, list(m.schedule(shares, iter(range(1000)), 1024)))


def test_stretches_do_not_depend_on_one_another():
    shares = m.whole([3, 0.4, 7, 2.5, 0.9, 11])
    alone = [slot for stretch in range(30) for slot in m.schedule(shares, iter([stretch]), 70)]
    assert alone == list(m.schedule(shares, iter(range(30)), 70))


def rows(n):
    return [(i, f"t{i}", "en", None if i % 10 == 0 else "big" if i % 3 else "small") for i in range(n)]


def plain_slots(weights, blocks):
    """The slots the mix ends with and whether windows hold, from a plain recount of what was found."""
    total = sum(weights.values())
    return {s: [(j * total // w, -(-(j + 1) * total // w)) for j in range(blocks[s])] for s, w in weights.items()}


@pytest.mark.parametrize("stretch", [16, 1024])
def test_all_rows_are_kept_in_their_blocks(documents, monkeypatch, stretch):
    monkeypatch.setattr(m, "RANK_ROWS", 50)
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    monkeypatch.setattr(m, "STRETCH", stretch)
    monkeypatch.setattr(m, "SLOTS_PER_SOURCE", 1)
    frame = documents(rows(1500), clash=True)
    found = m.mixed(frame).collect()
    assert sorted(r.doc_id for r in found) == list(range(1500))
    sizes = Counter(r.source for r in found)
    blocks = {s: -(-n // 8) for s, n in sizes.items()}
    held = Counter((r.source, r.mix_block) for r in found)
    assert all(n == 8 or block == sizes[source] // 8 for (source, block), n in held.items())
    slot_of = {(r.source, r.mix_block): r.mix_slot for r in found}
    # Every slot is filled by one block.
    assert sorted(slot_of.values()) == list(range(sum(blocks.values())))
    assert len({(r.mix_slot, r.mix_place) for r in found}) == 1500
    end = min(r.mix_slot for r in found if not r.in_mix)
    assert all(r.in_mix == (r.mix_slot < end) for r in found)
    windows = plain_slots({s: isqrt(n << 80) for s, n in sizes.items()}, blocks)
    left = defaultdict(int)
    for (source, block), slot in slot_of.items():
        release, deadline = windows[source][block]
        if slot < end:
            assert release <= slot < deadline
        else:
            left[source] += 1
    # The mix ends with a source that has no block left.
    assert any(not left[s] for s in sizes) and any(left.values())
    later = sorted((slot, windows[s][b][1]) for (s, b), slot in slot_of.items() if slot >= end)
    assert [d for _, d in later] == sorted(d for _, d in later)


def test_given_weights(documents):
    frame = documents(rows(600))
    found = m.mixed(frame, {"big": 3, "small": 1}).collect()
    assert len(found) == 600
    last = {s: min(r.mix_slot for r in found if r.source == s) for s in (None, "big", "small")}
    assert last[None] > max(r.mix_slot for r in found if r.source) and not any(r.in_mix for r in found if r.source is None)
    with pytest.raises(ValueError):
        m.mixed(frame, {"big": -1})
    with pytest.raises(ValueError):
        m.mixed(frame, {"other": 1})


def test_odd_rows_and_empty_table(documents, odd_rows):
    frame = documents(odd_rows, clash=True)
    found = m.mixed(frame)
    assert found.count() == len(odd_rows)
    assert found.columns == [c for c in frame.columns if c not in m.NEW] + list(m.NEW)
    empty = m.mixed(documents([]))
    assert empty.count() == 0 and empty.dtypes == found.select(empty.columns).dtypes


def test_whole_rows_are_exchanged_once(spark, documents, monkeypatch):
    monkeypatch.setattr(m, "RANK_ROWS", 50)
    # No side is small enough to be sent to all.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = m.mixed(documents(rows(1500)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_group#") == 1 and "SortMergeJoin [_group#" in plan


def test_query_mixes_whole_documents(spark):
    from lakeseed.llm.queries import op6_mixing

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = op6_mixing(spark, folder)
    assert mixed.columns == [*docs.columns, *m.NEW]
    assert mixed.select(docs.columns).exceptAll(docs).count() == 0 and mixed.count() == docs.count()

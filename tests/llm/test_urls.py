from __future__ import annotations

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeseed.llm import urls as u
from lakeseed.llm.components import components
from lakeseed.llm.queries import CHECKS


def link(target):
    return f'<html><head><LINK href="{target}" rel="canonical"></head>'


def refresh(target):
    return f"<meta http-equiv='refresh' content='0; url={target}'>"


PAGES = [
    (1, "http://a.example.org/es/1?x=1#y", None),
    (2, "https://WWW.Example.ORG/en/12", ""),
    (3, "http://org", ""),
    (4, "http://x.net/p", link("http://b.com/de/1")),
    (5, "http://y.net/q?utm_source=z", refresh("/r")),
    (6, "http://y.net/r", link("//x.net/p")),
    (7, "http://z.net/a/b", link("c")),
    (8, "http://z.net/a/c", link("http://b.com/fr/1") + refresh("http://b.com/de/9")),
    (9, "http://b.com/de/9", None),
    (10, None, link("http://b.com/de/1")),
    (11, "no scheme", link("http://b.com/de/1")),
    (12, "http://y.net/q#top", None),
    (12, "http://y.net/q#top", None),
    (13, "http://notexample.org/es/1", None),
    (14, "http://alone.net/", "<p>rel=canonical</p>"),
    (None, "http://example.org:80/es/", None),
    (15, "http://example.org?/es/", None),
    (16, "http://x.net/p?utm_source=q", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return frame.selectExpr("*", "'?' AS node", "'?' AS host", "'?' AS own", "'?' AS blocked", "'?' AS rule")


def test_rules_and_aliases(pages):
    found = {r.page_id: r for r in u.judged(pages).collect()}
    verdicts = {k: r.verdict for k, r in found.items()}
    assert [found[1].host, found[1].path, found[1].rule] == ["a.example.org", "/es/1", "example.org/es/"]
    assert found[2].rule == "example.org/en/1" and verdicts[2] == "block"
    assert found[3].rule is None and (found[3].host, found[3].path) == ("org", "")
    assert found[13].rule == "org/" and verdicts[13] == "allow"
    assert verdicts[4] == verdicts[5] == verdicts[6] == verdicts[12] == verdicts[16] == "block"
    assert verdicts[7] == verdicts[8] == "allow" and verdicts[9] == "block"
    assert verdicts[10] == verdicts[11] == verdicts[14] == "allow"
    assert (found[10].host, found[10].path, found[10].rule) == ("", "", None)
    assert (found[15].host, found[15].path) == ("example.org", "")


def test_like_sql(pages):
    want = duckdb.connect()
    want.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    want.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    rows = want.sql(CHECKS["op8_urls"]).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in u.judged(pages).collect())


def test_redirect_table(pages, spark):
    moves = spark.createDataFrame([("http://alone.net/", "http://b.com/de/1"), (None, "http://x.net")], "source string, target string")
    found = {r.page_id: r.verdict for r in u.judged(pages, redirects=moves).collect()}
    assert found[14] == "block"


def test_empty_table(pages):
    assert u.judged(pages.limit(0)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_like_union_find(spark, edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {(r.node, r.component) for r in components(frame).collect()} == {(x, root(x)) for x in up}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[2000 + i] for i in range(200)} == {1000}

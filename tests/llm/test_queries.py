"""The registered queries of this subpackage against their SQL checks, over whole tables."""

from __future__ import annotations

import pytest

from lakeseed.llm.queries import CHECKS, QUERIES
from tests.compare import check_connection, compare

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), check_connection(FOLDER), CHECKS[name]) == []

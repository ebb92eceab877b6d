"""Every registered query again on tables of many files, in another row order.

Joins may not broadcast by size, and Arrow batches are small.
"""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeseed.plans.queries import all_checks, all_queries
from lakeseed.sources.tables import TABLES, read_table, table_path
from lakeseed.workspace import new_path
from tests.compare import compare

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "13",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50",
}


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "tables")
    for name in TABLES:
        rows = read_table(spark, "/root/testdata/sf0.001", name)
        rows.repartition(5, F.xxhash64(*rows.columns)).write.parquet(table_path(path, name))
    return path


@pytest.fixture(scope="module")
def connection(folder):
    made = duckdb.connect()
    place = folder.removeprefix("file:")
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(place, name)}/*.parquet'")
    return made


@pytest.fixture(scope="module", autouse=True)
def hard_settings(spark):
    kept = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_check(spark, folder, connection, name):
    frame = all_queries()[name](spark, folder)
    assert compare(frame, connection, all_checks()[name]) == []

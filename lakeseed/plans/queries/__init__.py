"""Registered queries over the given tables, each with its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeseed.plans.queries import analytics, catalogs, extended, inputs, intervals, keyed, scalars, streams, surface, timed, vectors, writes
from lakeseed.session import configure

MODULES = (vectors, writes, keyed, inputs, catalogs, scalars, streams, surface, intervals, timed, analytics, extended)


def _configured(query):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder.rstrip("/"))

    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(query) for module in MODULES for name, query in module.QUERIES.items()}


def all_checks() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.CHECKS.items()}

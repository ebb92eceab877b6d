"""Mergeable sketches: states stored by group, merged later for any coarser group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the logarithm of a distinct sketch's size; its standard error is about 1.04 / sqrt(2 ** 12).
DISTINCT_LOG_SIZE = 12
#: A quantile sketch's size; ranks are right to about 1.7 % for this one.
QUANTILE_SIZE = 200


def distinct_states(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """A sketch of the distinct values of each group: of fixed size, whatever the group holds."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(DISTINCT_LOG_SIZE)).alias(name))


def distinct_count(states: DataFrame, keys: list[str], name: str) -> DataFrame:
    """About how many distinct values the stored groups hold together."""
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name))


def quantile_states(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """A sketch of the order of each group's numbers."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(QUANTILE_SIZE)).alias(name))


def quantiles(states: DataFrame, keys: list[str], name: str, shares: list[float]) -> DataFrame:
    """keys, share, value: about which number the given share of the merged groups' rows stays below."""
    if any(not 0 <= share <= 1 for share in shares):
        raise ValueError("shares lie between 0 and 1")
    merged = states.groupBy(*keys).agg(F.kll_merge_agg_double(name).alias(name))

    def at(share: Column) -> Column:
        return F.struct(share.alias("share"), F.kll_sketch_get_quantile_double(name, share).alias("value"))

    rows = merged.select(*keys, F.explode(F.array(*(at(F.lit(float(share))) for share in shares))).alias("q"))
    return rows.select(*keys, "q.share", "q.value")

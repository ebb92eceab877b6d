"""Write modes: append, insert-if-absent, upsert, put, strict create, owned difference.

Each takes the current rows and the incoming rows and returns the next version, so a
rerun over the same input gives the same result. ``seq`` columns state which row came
later; row order inside a frame is never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import stored


def append(base: DataFrame, incoming: DataFrame) -> DataFrame:
    return base.unionByName(incoming, allowMissingColumns=True)


def append_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append one batch to a Parquet collection; writing the batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _picked(rows: DataFrame, keys: list[str], seq: list[str], pick) -> DataFrame:
    rest = [column for column in rows.columns if column not in keys]
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """One row per key, the latest by ``seq``; partial aggregation shrinks hot keys first."""
    return _picked(rows, keys, seq, F.max_by)


def first_wins(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """One row per key, the earliest by ``seq``."""
    return _picked(rows, keys, seq, F.min_by)


def only_row(rows: DataFrame, keys: list[str], message: str) -> DataFrame:
    """The rows, failing the job on a key that occurs more than once."""
    rest = [column for column in rows.columns if column not in keys]
    counted = rows.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    single = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return counted.withColumn("_row", single).select(*keys, "_row.*").select(*rows.columns)


def with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, failing the job on a null key: no stored row could ever be replaced by it."""
    filled = {
        key: F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(f"{key} must not be null"))
        for key in keys
    }
    return rows.withColumns(filled)


def insert_if_absent(
    base: DataFrame, incoming: DataFrame, keys: list[str], seq: list[str]
) -> DataFrame:
    """Add incoming keys that are not present; present rows stay as they are."""
    fresh = first_wins(with_keys(incoming, keys), keys, seq).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Insert or replace by key; within the batch the latest row wins.

    ``base`` holds each key once already. The batch is aggregated once and written, so
    its size is known and it is not computed again; ``base`` is only filtered by the
    batch keys, so a small batch leaves the large side without a shuffle.
    """
    winners = stored(last_wins(with_keys(batch, keys), keys, seq), "winners")
    kept = base.join(winners.select(*keys), keys, "left_anti")
    return kept.unionByName(winners.select(*base.columns))


def require_filled(rows: DataFrame, column: str, message: str) -> DataFrame:
    """Fail the job on a row whose ``column`` is null or empty."""
    return rows.withColumn(column, filled_or_error(F.col(column), message))


def filled_or_error(text: Column, message: str) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(
        F.raise_error(message).cast("string")
    )


def put(base: DataFrame, batch: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Put with overwrite: blank names are an error, a blank type becomes ``String``."""
    named = require_filled(batch, key, f"{key} is required")
    if "type" in named.columns:
        blank = F.coalesce(F.col("type"), F.lit("")) == ""
        named = named.withColumn("type", F.when(blank, "String").otherwise(F.col("type")))
    return upsert(base, named, [key], seq)


def create_strict(rows: DataFrame, path: str, name: str) -> None:
    """Create a Parquet table; an existing one or a blank name is an error."""
    if not name:
        raise ValueError("table name is required")
    rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def owned_difference(declared: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows whose key was not there before, the only ones a clean-up may delete."""
    return declared.join(existing.select(*keys).distinct(), keys, "left_anti")

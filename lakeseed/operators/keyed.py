"""Key/value lookup, document filters and tables with partition and sort keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.functions.scalars import variant_kind


def lookup(probes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Value of each probe's key, null when the key is missing.

    ``pairs`` holds each key once. The planner broadcasts it if it is small; otherwise
    adaptive execution splits the partitions of hot probe keys.
    """
    return probes.join(pairs, key, "left")


# Variant types that a value of each Python type may equal.
NUMBERS = ["BIGINT", "DOUBLE", "DECIMAL"]
EQUAL_KINDS = {bool: ["BOOLEAN"], int: NUMBERS, float: NUMBERS, str: ["STRING"]}
COMPARED_AS = {bool: "boolean", int: "decimal(38,15)", float: "double", str: "string"}


# Fixed value: whole numbers with more digits are stored as DOUBLE.
DECIMAL_DIGITS = 38


def field_path(path: str | tuple[str, ...]) -> str:
    """A dotted path, or a tuple of field names that may themselves hold dots."""
    if isinstance(path, str):
        return f"$.{path}"
    if any("'" in name and '"' in name for name in path):
        raise ValueError("a field name may not hold quotes of both kinds")
    return "$" + "".join(f'["{name}"]' if "'" in name else f"['{name}']" for name in path)


def field_equals(document: str, path: str | tuple[str, ...], value: object) -> Column:
    """Whether a field of a document equals a value of the same kind; 1 equals 1.0, not "1".

    ``None`` equals a null and an absent field.
    """
    where = field_path(path)
    field = F.try_variant_get(document, where, "variant")
    if value is None:
        return field.isNull() | F.is_variant_null(field)
    kind = type(value)
    if kind is int and abs(value) >= 10**DECIMAL_DIGITS:
        kind, value = float, float(value)
    if kind is int and abs(value) >= 1 << 63:
        # Such a number is kept as a decimal without a fraction; a cast would round one that has a fraction.
        whole = F.schema_of_variant(field).rlike(r"^DECIMAL\(\d+,0\)$")
        return whole & (F.try_variant_get(document, where, f"decimal({DECIMAL_DIGITS},0)") == F.lit(Decimal(value)))
    typed = F.try_variant_get(document, where, COMPARED_AS[kind])
    return (typed == F.lit(value)) & variant_kind(field).isin(EQUAL_KINDS[kind])


def count_documents(
    documents: DataFrame, document: str, equal: dict[str | tuple[str, ...], object]
) -> DataFrame:
    """Count documents whose fields equal all the given values."""
    matching = documents
    for path, value in equal.items():
        matching = matching.where(field_equals(document, path, value))
    return matching.agg(F.count(F.lit(1)).alias("documents"))


def keyed_table(rows: DataFrame, partition_key: str = "", sort_key: str = "") -> DataFrame:
    """Lay rows out by partition key (``id`` if blank) and optional sort key, both as text.

    Range partitioning splits a hot partition key along its sort key and, where that is
    equal or absent, along the input partition. The sorted files let Parquet statistics
    skip everything outside a key range.
    """
    keys = [partition_key or "id", *([sort_key] if sort_key else [])]
    texts = rows.withColumns({key: F.col(key).cast("string") for key in keys})
    marked = texts.withColumn("_copy", F.spark_partition_id())
    return marked.repartitionByRange(*keys, "_copy").sortWithinPartitions(*keys).drop("_copy")


def key_range(
    table: DataFrame,
    partition_key: str,
    value: str,
    sort_key: str | None = None,
    low: str | None = None,
    high: str | None = None,
) -> DataFrame:
    """Rows of one partition key, optionally within an inclusive sort key range."""
    found = table.where(F.col(partition_key) == value)
    if sort_key is not None and low is not None:
        found = found.where(F.col(sort_key) >= low)
    if sort_key is not None and high is not None:
        found = found.where(F.col(sort_key) <= high)
    return found


def key_ranges(table: DataFrame, ranges: DataFrame, partition_key: str, sort_key: str) -> DataFrame:
    """The same for many partition keys at once.

    ``ranges`` holds each partition key once with ``low`` and ``high``.
    """
    joined = table.join(ranges, partition_key)
    return joined.where(F.col(sort_key).between(F.col("low"), F.col("high"))).drop("low", "high")

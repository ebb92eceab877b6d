"""Stored vector collections: catalog tables that keep their size and metric, in buckets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.vectors import Collection
from lakeseed.operators.write import last_wins, only_row, with_keys
from lakeseed.plans.catalog import quoted
from lakeseed.workspace import new_path, stored

COLUMNS = "id STRING, vector ARRAY<DOUBLE>, payload VARIANT, bucket INT"
# The setting by which an overwrite leaves the partitions alone that it has no rows for.
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
# Buckets of a collection; a load writes the buckets that it touches again.
BUCKETS = 64


def _table(catalog: str, name: str) -> str:
    return f"`{catalog}`.`{name}`"


def create_collection(
    spark: SparkSession, catalog: str, collection: Collection, buckets: int = BUCKETS
) -> None:
    """Create the collection, or update the size and metric of one that exists.

    Choose ``buckets`` by size: each holds its share of the points, and a load that touches
    it writes that share again. The number is fixed when the collection is created.
    """
    table = _table(catalog, collection.name)
    settings = f"'size' = '{collection.size}', 'metric' = '{collection.metric}'"
    if not spark.catalog.tableExists(table):
        path = quoted(new_path(spark, f"collection-{collection.name}"))
        spark.sql(
            f"CREATE TABLE {table} ({COLUMNS}) USING parquet PARTITIONED BY (bucket) "
            f"TBLPROPERTIES ({settings}, 'buckets' = '{buckets}') LOCATION {path}"
        )
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({settings})")


def _settings(spark: SparkSession, catalog: str, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {_table(catalog, name)}").collect()
    return {row["key"]: row["value"] for row in rows}


def open_collection(spark: SparkSession, catalog: str, name: str) -> Collection:
    """Size and metric of a stored collection."""
    settings = _settings(spark, catalog, name)
    return Collection(name, int(settings["size"]), settings["metric"])


def read_collection(spark: SparkSession, catalog: str, name: str) -> DataFrame:
    return spark.table(_table(catalog, name)).drop("bucket")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_points(points: DataFrame, catalog: str, name: str, seq: list[str] | None = None) -> None:
    """Insert or update points; when this returns, readers see all of them.

    Only the buckets of the given ids are read and written again; the others stay as they
    are. Each bucket's next version is complete before it takes the place of the current
    one, and a load that failed half-way may be repeated. A collection takes one load at a
    time. Without ``seq`` an id that occurs twice is an error, and so is a null id.
    """
    spark = points.sparkSession
    collection = open_collection(spark, catalog, name)
    buckets = int(_settings(spark, catalog, name)["buckets"])
    incoming = collection.checked(points).select(
        F.col("id").cast("string").alias("id"),
        F.col("vector").cast("array<double>").alias("vector"),
        "payload",
        *[F.col(column).alias(f"_seq_{column}") for column in seq or []],
    )
    incoming = with_keys(incoming, ["id"])
    if seq:
        incoming = last_wins(incoming, ["id"], [f"_seq_{column}" for column in seq])
    else:
        incoming = only_row(incoming, ["id"], f"an id occurs twice in a load of {name}; order the rows by seq")
    batch = incoming.select("id", "vector", "payload", _bucket(F.col("id"), buckets).alias("bucket"))
    batch = stored(batch, f"load-{name}")
    # At most as many numbers as the collection has buckets.
    touched = [row["bucket"] for row in batch.select("bucket").distinct().collect()]
    current = spark.table(_table(catalog, name)).where(F.col("bucket").isin(touched))
    kept = current.join(batch.select("id", "bucket"), ["id", "bucket"], "left_anti")
    merged = stored(kept.select(*batch.columns).unionByName(batch), f"version-{name}")
    kept_mode = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        merged.repartition("bucket").write.insertInto(_table(catalog, name), overwrite=True)
    finally:
        spark.conf.set(OVERWRITE, kept_mode)
    spark.catalog.refreshTable(_table(catalog, name))

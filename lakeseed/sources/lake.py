"""Lake tables: partitioned Parquet under a warehouse folder, or a lake format's catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeseed.plans.catalog import quoted
from lakeseed.workspace import new_path, shared_root


@dataclass(frozen=True)
class LakeEnvironment:
    """Warehouse bucket and catalog name with their defaults."""

    # The default names.
    bucket: str = "warehouse"
    catalog: str = "iceberg"

    def location(self, spark: SparkSession) -> str:
        return f"{shared_root(spark)}/lakeseed/{self.bucket or 'warehouse'}"

    def create(self, spark: SparkSession) -> None:
        """Make the catalog's database in the warehouse folder."""
        spark.sql(
            f"CREATE DATABASE IF NOT EXISTS `{self.catalog}` LOCATION {quoted(self.location(spark))}"
        )

    def rest_settings(self, uri: str, warehouse: str) -> dict[str, str]:
        """Session settings for a REST lake catalog whose jar the cluster supplies."""
        name = f"spark.sql.catalog.{self.catalog}"
        return {
            name: "org.apache.iceberg.spark.SparkCatalog",
            f"{name}.type": "rest",
            f"{name}.uri": uri,
            f"{name}.warehouse": warehouse,
        }


def create_lake_table(
    spark: SparkSession, environment: LakeEnvironment, table: str, like: DataFrame, by: str
) -> str:
    """Create an empty partitioned table with the columns of ``like``; it must be new."""
    environment.create(spark)
    columns = ", ".join(f"`{item.name}` {item.dataType.simpleString()}" for item in like.schema)
    name = f"`{environment.catalog}`.`{table}`"
    path = quoted(new_path(spark, f"{environment.bucket}-{table}"))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({by}) LOCATION {path}")
    return name


def insert_lake_rows(rows: DataFrame, table: str, by: str) -> None:
    """Append rows by name.

    The rebalance hint gives each table partition files of about the advisory size: a
    partition with a third of the rows is split, small ones share a task.
    """
    columns = rows.sparkSession.table(table).columns
    rows.select(*columns).hint("rebalance", by).write.insertInto(table)

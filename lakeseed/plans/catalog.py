"""Named catalogs, SQL over them and joins between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakeseed.workspace import shared_root

# Fixed value: the catalog that exists when none was declared.
MEMORY = "memory"
# The property that names a connector, the second in short.
CONNECTOR = ("connector.name", "connector")
# Properties of a lake catalog and the Spark settings below its name that they stand for.
LAKE = "iceberg"
LAKE_SETTINGS = {
    "iceberg.catalog.type": "type",
    "iceberg.rest-catalog.uri": "uri",
    "iceberg.rest-catalog.warehouse": "warehouse",
    "s3.endpoint": "s3.endpoint",
    "s3.aws-access-key": "s3.access-key-id",
    "s3.aws-secret-key": "s3.secret-access-key",
    "s3.path-style-access": "s3.path-style-access",
}
LAKE_CATALOG = "org.apache.iceberg.spark.SparkCatalog"
NATIVE_FILES = ("fs.native-s3.enabled", "io-impl", "org.apache.iceberg.aws.s3.S3FileIO")


def quoted(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def query(spark: SparkSession, sql: str, **parameters: object) -> DataFrame:
    """Forward SQL text unparsed; the result is complete, not a first page."""
    return spark.sql(sql, args=parameters or None)


def catalog_settings(name: str, properties: dict[str, str]) -> dict[str, str]:
    """Session settings of a catalog; none for one that is kept as a database.

    Every property must be known: the lake connector's are translated, those of a catalog
    class are passed on, and the memory connector has none.
    """
    given = [properties[key] for key in CONNECTOR if key in properties]
    connector = given[0] if given else MEMORY
    rest = {key: value for key, value in properties.items() if key not in CONNECTOR}
    prefix = f"spark.sql.catalog.{name}"
    if "." in connector:
        return {prefix: connector, **{f"{prefix}.{key}": value for key, value in rest.items()}}
    if connector == LAKE:
        settings = {prefix: LAKE_CATALOG}
        if rest.pop(NATIVE_FILES[0], "false").lower() == "true":
            settings[f"{prefix}.{NATIVE_FILES[1]}"] = NATIVE_FILES[2]
        settings |= {f"{prefix}.{LAKE_SETTINGS[key]}": rest.pop(key) for key in list(rest) if key in LAKE_SETTINGS}
    elif connector == MEMORY:
        settings = {}
    else:
        raise ValueError(f"unknown connector {connector!r} of catalog {name}")
    if rest:
        raise ValueError(f"unknown property {sorted(rest)[0]!r} of catalog {name}")
    return settings


@dataclass
class Catalogs:
    """Declared catalogs: name to properties."""

    declared: dict[str, dict[str, str]] = field(default_factory=dict)

    def with_catalog(self, name: str, properties: dict[str, str]) -> Catalogs:
        """Declare a catalog; the same name replaces, and the properties are copied."""
        if not name:
            raise ValueError("catalog name is required")
        catalog_settings(name, properties)
        self.declared[name] = dict(properties)
        return self

    def with_memory(self, name: str = MEMORY) -> Catalogs:
        return self.with_catalog(name or MEMORY, {CONNECTOR[0]: MEMORY})

    def resolved(self) -> dict[str, dict[str, str]]:
        """The declared catalogs, or one named ``memory`` if there are none."""
        return self.declared or {MEMORY: {CONNECTOR[0]: MEMORY}}

    def register(self, spark: SparkSession) -> list[str]:
        """Make each catalog usable in this session: as a Spark catalog, or as a database."""
        for name, properties in self.resolved().items():
            settings = catalog_settings(name, properties)
            for key, value in settings.items():
                spark.conf.set(key, value)
            if not settings:
                place = quoted(f"{shared_root(spark)}/lakeseed/catalogs/{name}")
                spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION {place}")
        return list(self.resolved())

    def show(self, spark: SparkSession) -> DataFrame:
        """Names of the session's own catalogs and of all declared ones."""
        declared = spark.createDataFrame([(name,) for name in self.resolved()], "catalog string")
        return spark.sql("SHOW CATALOGS").union(declared).distinct()


def mount(spark: SparkSession, catalog: str, table: str, path: str) -> str:
    """Put a Parquet path into a catalog as a table; the same name replaces."""
    name = f"`{catalog}`.`{table}`"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION {quoted(path)}")
    return name

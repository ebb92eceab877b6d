"""Row-store databases over JDBC.

The drivers are not bundled; put the database's jar on the class path. The functions
only set up Spark's own JDBC source, which splits a read by a numeric column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

# Fixed value: connections that one job opens to a store unless the caller says otherwise.
DEFAULT_CONNECTIONS = 25
FETCH_ROWS = 10_000


@dataclass(frozen=True)
class RowStore:
    """Address and credentials of a ``postgresql`` or ``mysql`` database."""

    kind: str
    host: str
    port: int
    database: str
    user: str = ""
    password: str = field(default="", repr=False)

    def __post_init__(self):
        if self.kind not in ("postgresql", "mysql"):
            raise ValueError(f"unknown row store {self.kind!r}")

    def url(self) -> str:
        # Fixed value: the option with which this store is reached on a local network.
        option = "?sslmode=disable" if self.kind == "postgresql" else ""
        return f"jdbc:{self.kind}://{self.host}:{self.port}/{quote(self.database)}{option}"

    def connection_string(self) -> str:
        """The store's own connection text, for clients other than Spark."""
        address = f"{self.host}:{self.port}"
        if self.kind == "postgresql":
            login = f"{self.user}:{self.password}"
            return f"postgresql://{login}@{address}/{self.database}?sslmode=disable"
        return f"{self.user}:{self.password}@tcp({address})/{self.database}"

    def options(self) -> dict[str, str]:
        return {
            "url": self.url(),
            "user": self.user,
            "password": self.password,
            "fetchsize": str(FETCH_ROWS),
        }


@dataclass(frozen=True)
class Split:
    """How a table is read in parallel: ranges of a numeric column."""

    column: str
    lower: int
    upper: int
    parts: int = DEFAULT_CONNECTIONS

    def options(self) -> dict[str, str]:
        if self.upper <= self.lower:
            raise ValueError("upper bound must be above lower bound")
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(max(1, self.parts)),
        }


def read_store(spark: SparkSession, store: RowStore, table: str, split: Split) -> DataFrame:
    """Read a table; filters and columns are pushed down to the database."""
    options = {**store.options(), **split.options(), "dbtable": table}
    return spark.read.format("jdbc").options(**options).load()


def write_store(
    rows: DataFrame, store: RowStore, table: str, mode: str = "append", connections: int = DEFAULT_CONNECTIONS
) -> None:
    """Write through a bounded number of connections."""
    options = {**store.options(), "dbtable": table, "numPartitions": str(connections)}
    rows.write.format("jdbc").mode(mode).options(**options).save()

"""Paged results: a query's rows written once, in order, and read page by page."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeseed.operators.skew import ordered_scan
from lakeseed.workspace import new_path

PAGE, ROW = "page", "row"
PAGE_ROWS = 1000


@dataclass(frozen=True)
class Pages:
    """A stored result: its folder, columns, number of rows and rows of a page."""

    path: str
    schema: StructType
    rows: int
    size: int

    @property
    def last(self) -> int:
        """The number of the last page; a result without rows has one empty page."""
        return max(self.rows - 1, 0) // self.size

    def read(self, spark: SparkSession, page: int) -> DataFrame:
        """One page's rows, in order: only its own folder is read, and nothing is computed again."""
        if not 0 <= page <= self.last:
            raise ValueError(f"no page {page}")
        stored = StructType([*self.schema.fields, *StructType().add(ROW, "long")])
        if not self.rows:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(stored).parquet(f"{self.path}/{PAGE}={page}").orderBy(ROW).drop(ROW)

    def all(self, spark: SparkSession) -> DataFrame:
        """The whole result with the page and the number of each row."""
        return _stored(spark, self.path, self.schema)

    def token(self, page: int) -> str | None:
        """What a caller hands in to get a page; none for the page after the last one."""
        if page > self.last:
            return None
        state = {"path": self.path, "schema": self.schema.jsonValue(), "rows": self.rows, "size": self.size, "page": page}
        return base64.urlsafe_b64encode(json.dumps(state).encode()).decode()


def paged(result: DataFrame, order: list[str], size: int = PAGE_ROWS) -> Pages:
    """Write a result in a total order, a folder for every page.

    Rows are numbered in range parts, so no task sorts the whole result; rows that agree in all of ``order``
    are told apart by their other columns where these can be ordered. The number of a row says its page.
    """
    if size <= 0:
        raise ValueError("a page has one row at least")
    if {PAGE, ROW, "_all"} & set(result.columns):
        raise ValueError(f"columns {PAGE}, {ROW} and _all are used by the pages")
    rest = [f.name for f in result.schema if f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    numbered = ordered_scan(
        result.select(*(F.col(f"`{name}`") for name in result.columns), F.lit(0).alias("_all"), F.lit(1).alias("_one")),
        ["_all"], [*order, *rest], sums={ROW: "_one"},
    )
    numbered = numbered.drop("_all", "_one").withColumn(ROW, F.col(ROW) - 1)
    numbered = numbered.withColumn(PAGE, F.expr(f"{ROW} div {size}"))
    path = new_path(result.sparkSession, "pages")
    # Pages lie next to each other in the order, so a task writes a few whole ones.
    numbered.repartitionByRange(PAGE).write.partitionBy(PAGE).parquet(path)
    return Pages(path, result.schema, _stored(result.sparkSession, path, result.schema).count(), size)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields, *StructType().add(ROW, "long").add(PAGE, "long")])
    return spark.read.schema(full).parquet(path)


def next_page(spark: SparkSession, token: str) -> tuple[DataFrame, str | None]:
    """The page a token names, and the token of the page after it, in any session that reaches the folder."""
    state = json.loads(base64.urlsafe_b64decode(token))
    pages = Pages(state["path"], StructType.fromJson(state["schema"]), state["rows"], state["size"])
    return pages.read(spark, state["page"]), pages.token(state["page"] + 1)

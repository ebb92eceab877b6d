"""Document collections: JSON documents stored as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.write import append_batch

# Fixed value: database of a collection that names none.
DEFAULT_DATABASE = "test"


def collection_path(root: str, collection: str, database: str = "") -> str:
    if not collection:
        raise ValueError("collection name is required")
    return f"{root}/{database or DEFAULT_DATABASE}/{collection}"


def as_documents(rows: DataFrame, json: Column) -> DataFrame:
    """One variant column ``doc``; text that is not JSON fails the job."""
    return rows.select(F.parse_json(json).alias("doc"))


def insert_documents(documents: DataFrame, path: str, batch_id: str) -> None:
    """Append documents as one batch; the same batch again replaces itself."""
    append_batch(documents, path, batch_id)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc")

"""Text files: recursive manifests by suffix and service logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.workspace import is_folder

# Fixed value: suffixes that count as manifests inside a folder.
MANIFEST_SUFFIXES = ["yaml", "yml"]


def is_remote(path: str) -> bool:
    """Web addresses are not walked as folders."""
    return path.startswith(("http://", "https://"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Whole text of each manifest below a folder: ``path, text``.

    A path that is a single file is taken whatever its suffix.
    """
    if is_remote(path):
        raise ValueError("a web address is not a file or folder")
    reader = spark.read.option("recursiveFileLookup", "true")
    if is_folder(spark, path):
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(MANIFEST_SUFFIXES) + "}")
    texts = reader.text(path, wholetext=True)
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return texts.select(decoded.alias("path"), F.col("value").alias("text"))


def read_logs(spark: SparkSession, services: dict[str, str], streaming: bool = False) -> DataFrame:
    """Log lines of several services as one frame: ``service, line``."""
    if not services:
        raise ValueError("at least one service is required")
    reader = spark.readStream if streaming else spark.read
    lines = [
        reader.option("lineSep", "\n").text(path).select(F.lit(name).alias("service"), F.col("value").alias("line"))
        for name, path in services.items()
    ]
    return reduce(DataFrame.unionByName, lines)

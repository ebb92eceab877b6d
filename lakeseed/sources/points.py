"""Vector points as JSON arrays in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.functions.scalars import json_without_blanks

POINT = "id string, vector array<double>, payload variant"

def read_points(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Points ``id, vector, payload``; malformed JSON fails the whole load.

    ``path`` is a file, a folder or a pattern of files that each hold one JSON array.
    Ids are read as text, so whole numbers of any size stay exact. With ``lines``
    every line holds an array or a point, and large files are split between tasks.
    """
    reader = spark.read.schema(POINT).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    return reader.option("multiLine", str(not lines).lower()).json(path)


def point_json(id_column: Column, vector: Column, payload: Column) -> Column:
    """A point as JSON; an empty payload is left out. ``payload`` is a map column."""
    return json_without_blanks({"id": id_column, "vector": vector}, nested={"payload": payload})


def write_points(points: DataFrame, path: str, point: Column) -> None:
    """Write points as JSON arrays, one of one point to a line, so that files of any size are split to be read."""
    points.select(F.concat(F.lit("["), point, F.lit("]"))).write.mode("overwrite").text(path)

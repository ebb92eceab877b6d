"""Streams by event time: late rows kept aside, sessions, sliding windows, and joins of two streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeseed.workspace import new_folder, new_path


@dataclass(frozen=True)
class Job:
    """A stream's own folder: its checkpoint, and what it has written so far. Runs go on where the last one ended."""

    path: str
    schema: StructType

    def append(self, rows: DataFrame, mode: str = "append") -> None:
        """Run over what is there now, writing each row once."""
        run = rows.writeStream.format("parquet").outputMode(mode).option("path", f"{self.path}/rows")
        run.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def job(rows: DataFrame, label: str) -> Job:
    """A new job that writes rows like these."""
    path = new_path(rows.sparkSession, label)
    new = Job(path, rows.schema)
    # The folder is there before the first row is, so it can be read at any time.
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(f"{path}/rows")
    return new


@dataclass(frozen=True)
class Split:
    """Rows of a stream that came in time, and those that came too late."""

    path: str
    schema: StructType
    at: str
    late: str

    def add(self, rows: DataFrame) -> None:
        """Take in what is there now. Like Spark's watermark, the limit moves after a batch, never within it.

        Each batch writes its rows and its latest time under its own number, and the
        limit of a batch comes from the numbers before it, so one that runs again does the
        same again.
        """
        spark = rows.sparkSession

        def place(batch: DataFrame, batch_id: int) -> None:
            earlier = _under(spark.read, f"{self.path}/latest", LATEST).where(F.col("batch") < batch_id)
            limit = earlier.agg((F.max("latest") - F.expr(f"INTERVAL {self.late}")).alias("limit")).first()[0]
            in_time = F.lit(True) if limit is None else F.coalesce(F.col(self.at) >= F.lit(limit), F.lit(True))
            batch.where(in_time).write.mode("overwrite").parquet(f"{self.path}/in_time/{batch_id}")
            batch.where(~in_time).write.mode("overwrite").parquet(f"{self.path}/late/{batch_id}")
            latest = batch.agg(F.max(self.at).alias("latest"), F.lit(batch_id).cast("long").alias("batch"))
            latest.write.mode("overwrite").parquet(f"{self.path}/latest/{batch_id}")

        run = rows.writeStream.foreachBatch(place).option("checkpointLocation", f"{self.path}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return _under(spark.read, f"{self.path}/late", self.schema)

    def in_time(self, spark: SparkSession) -> DataFrame:
        """The rows in time as a stream; none of them is late for the same limit."""
        return _under(spark.readStream, f"{self.path}/in_time", self.schema)


LATEST = StructType().add("latest", "timestamp").add("batch", "long")


def _under(reader, path: str, schema: StructType) -> DataFrame:
    """The rows of all folders below a path."""
    return reader.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def split_late(rows: DataFrame, at: str, late: str) -> Split:
    """A place for a stream's rows, told apart by whether they are older than ``late`` before the latest time."""
    spark = rows.sparkSession
    split = Split(new_folder(spark, "split"), rows.schema, at, late)
    for name, schema in (("in_time", rows.schema), ("late", rows.schema), ("latest", LATEST)):
        spark.createDataFrame([], schema).write.parquet(f"{split.path}/{name}/none")
    return split


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str, late: str, *aggregates: Column) -> DataFrame:
    """Sessions of a stream: rows of a key that follow each other within ``gap``.

    ``session_start`` is the first row's time, ``session_end`` the last one's plus the gap. A session
    comes out once, when the watermark, ``late`` behind the latest time, has passed its end;
    partial sessions of a task are merged before they are exchanged.
    """
    spans = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("span"), *keys).agg(*aggregates)
    return spans.select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "*").drop("span")


def sliding(rows: DataFrame, keys: list[str], at: str, width: str, step: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates over windows of ``width`` that begin every ``step``; each comes out once, when it is closed."""
    spans = rows.withWatermark(at, late).groupBy(F.window(at, width, step).alias("span"), *keys).agg(*aggregates)
    return spans.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "*").drop("span")


def follows(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within: str, late: str, how: str = "inner"
) -> DataFrame:
    """Pairs of a left row and a right row of the same keys up to ``within`` after it, from two streams.

    Both sides have watermarks, and the bound on the distance tells when a row can meet no
    other any more, so the state holds rows of about ``within`` plus ``late`` only. With ``left`` a
    row that met nothing comes out when that is sure. Column names other than the keys must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError("a join of streams is inner or left")
    renamed = {key: f"_{key}" for key in keys}
    left, right = left.withWatermark(left_at, late), right.withWatermark(right_at, late).withColumnsRenamed(renamed)
    near = F.expr(f"`{right_at}` >= `{left_at}` AND `{right_at}` <= `{left_at}` + INTERVAL {within}")
    for key in keys:
        near = near & (F.col(key) == F.col(f"_{key}"))
    return left.join(right, near, "left_outer" if how == "left" else "inner").drop(*renamed.values())

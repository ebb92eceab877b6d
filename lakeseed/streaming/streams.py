"""Streams with shards, and topics fanned out to queues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeseed.operators.write import last_wins
from lakeseed.workspace import new_folder, new_path


@dataclass(frozen=True)
class Stream:
    """A stream by name; a shard count below one means one shard."""

    name: str
    shards: int = 1

    def __post_init__(self):
        if not self.name:
            raise ValueError("stream name is required")
        if self.shards <= 0:
            object.__setattr__(self, "shards", 1)

    def shard(self, key: Column) -> Column:
        """Shard number of a whole-number key. A label only: rows are not moved by it."""
        return F.pmod(key, F.lit(self.shards)).cast("int")


def open_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of Parquet files at a path, be it one file or a folder."""
    # A pattern matches both; a plain path to a single file is refused by the source.
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    )


def drain(rows: DataFrame, label: str, partition_by: list[str]) -> DataFrame:
    """Run the stream over what is there now and read the result back as a batch."""
    spark = rows.sparkSession
    out = new_path(spark, label)
    run = (
        rows.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def shard_events(rows: DataFrame, stream: Stream, key: str) -> DataFrame:
    """Write a stream by shard and return the written rows."""
    return drain(rows.withColumn("shard", stream.shard(F.col(key))), stream.name, ["shard"])


@dataclass(frozen=True)
class Route:
    """Events of one topic on one bus go to a queue. No route, no delivery."""

    bus: str
    topic: str
    queue: str


def fan_out(rows: DataFrame, routes: list[Route], bus: str, topic: str) -> DataFrame:
    """Deliver each row to every queue routed from its bus and topic.

    Each micro-batch is written once, partitioned by queue, under its batch id; a batch
    that runs again replaces its own files.
    """
    spark = rows.sparkSession
    rules = spark.createDataFrame(
        [(route.bus, route.topic, route.queue) for route in routes],
        f"`{bus}` string, `{topic}` string, queue string",
    ).distinct()
    out = new_path(spark, "queues")
    delivered = new_folder(spark, "queue-rows")

    def routed(batch: DataFrame) -> DataFrame:
        # The rules are the declared routes, a list in the driver's own code.
        return batch.join(F.broadcast(rules), [bus, topic])

    def deliver(batch: DataFrame, batch_id: int) -> None:
        writer = routed(batch).write.mode("overwrite").partitionBy("queue")
        writer.parquet(f"{delivered}/batch={batch_id}")

    run = (
        rows.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    # The schema is given because queue names like 007 must stay text.
    schema = routed(rows).schema.add("batch", "long")
    return spark.read.schema(schema).parquet(delivered).drop("batch")


def tumbling(rows: DataFrame, at: str, width: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates per time window of a stream, with the open windows included.

    Each batch writes the windows that it changed under its own number, and the last
    version of a window counts. Rows later than ``late`` behind the latest time are
    dropped, and with them the state of windows that nothing can change any more.
    """
    spark = rows.sparkSession
    out = new_path(spark, "windows")
    counted = new_folder(spark, "window-rows")
    windows = (
        rows.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("window"))
        .agg(*aggregates)
        .select(F.col("window.start").alias("window_start"), "*")
        .drop("window")
    )

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counted}/batch={batch_id}")

    run = (
        windows.writeStream.outputMode("update")
        .foreachBatch(replace)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    versions = spark.read.schema(windows.schema.add("batch", "long")).parquet(counted)
    return last_wins(versions, ["window_start"], ["batch"]).drop("batch")

"""Sharded logs: append-only files by shard, read as a batch or as a stream that goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType

from lakeseed.workspace import file_system

FORMAT = "sharded_log"
#: Columns that tell where a record stands: its shard, and its number there from 0 on without gaps.
SHARD, NUMBER = "shard", "number"
#: Rows of a batch that a task passes on.
ROWS = 10_000
WIDTH = 12


@dataclass
class ShardRange(InputPartition):
    """Records of one shard: the numbers from ``start`` up to ``end``, and the files that hold them."""

    shard: int
    start: int
    end: int
    files: tuple[tuple[int, str], ...]


def shard_path(path: str, shard: int) -> str:
    return f"{path.rstrip('/')}/{SHARD}-{shard}"


def _segments(path: str, shard: int) -> list[tuple[int, int, str]]:
    """(first number, end, file) of a shard's files, in order; a file's name tells its numbers."""
    store, place = file_system(shard_path(path, shard))
    found = []
    for entry in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        first, _, end = entry.base_name.removesuffix(".parquet").partition("-")
        if entry.base_name.endswith(".parquet") and first.isdigit() and end.isdigit():
            found.append((int(first), int(end), f"{shard_path(path, shard)}/{entry.base_name}"))
    return sorted(found)


def append(rows: DataFrame, path: str, key: str, shards: int) -> None:
    """Add rows to a log, each to the shard of its key: one more file for each shard that gets any.

    A shard is written by one task, as its records are numbered in order; give a log as many
    shards as it needs. A task writes a file aside and moves it to its name, which
    holds the record numbers, so a file is there whole or not at all, and one that is written again after
    a lost executor replaces itself. One append at a time.
    """
    if shards <= 0:
        raise ValueError("a log needs one shard at least")
    spark, base = rows.sparkSession, rows.columns
    ends = {shard: max((end for _, end, _ in _segments(path, shard)), default=0) for shard in range(shards)}
    schema, attempt = rows.schema, uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for shard in table[SHARD].unique().to_pylist():
                part = table.filter(pa.compute.equal(table[SHARD], shard)).select(base)
                if shard not in open_:
                    store, place = file_system(shard_path(path, shard))
                    store.create_dir(place, recursive=True)
                    aside = f"{place}/_{attempt}-{uuid.uuid4().hex}"
                    open_[shard] = [store, place, aside, pq.ParquetWriter(store.open_output_stream(aside), part.schema), 0]
                open_[shard][3].write_table(part)
                open_[shard][4] += part.num_rows
        for shard, (store, place, aside, writer, n) in open_.items():
            writer.close()
            store.move(aside, f"{place}/{ends[shard]:0{WIDTH}}-{ends[shard] + n:0{WIDTH}}.parquet")
        yield pa.RecordBatch.from_pydict({SHARD: pa.array(list(open_), pa.int32())})

    shard = F.pmod(F.col(key), F.lit(shards)).cast("int")
    dealt = rows.withColumn(SHARD, shard).repartition(shards, SHARD)
    dealt.mapInArrow(write, f"{SHARD} int").write.format("noop").mode("overwrite").save()


def _read(part: ShardRange, names: list[str]) -> Iterator[pa.RecordBatch]:
    for first, file in part.files:
        store, place = file_system(file)
        at = first
        for batch in pq.ParquetFile(store.open_input_file(place)).iter_batches(ROWS):
            low, high = max(part.start - at, 0), min(part.end - at, batch.num_rows)
            if low < high:
                piece = batch.slice(low, high - low)
                columns = {name: piece[name] for name in piece.schema.names}
                columns[SHARD] = pa.array([part.shard] * len(piece), pa.int64())
                columns[NUMBER] = pa.array(range(at + low, at + high), pa.int64())
                yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)
            at += batch.num_rows


class _Log:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.shards = options["path"], int(options["shards"])
        self.names = schema.names

    def ends(self) -> dict[str, int]:
        """The next record's number in every shard."""
        return {str(s): max((end for _, end, _ in _segments(self.path, s)), default=0) for s in range(self.shards)}

    def ranges(self, start: dict, end: dict) -> list[ShardRange]:
        out = []
        for shard in range(self.shards):
            low, high = start.get(str(shard), 0), end.get(str(shard), 0)
            files = tuple((a, f) for a, b, f in _segments(self.path, shard) if a < high and b > low) if low < high else ()
            if files:
                out.append(ShardRange(shard, low, high, files))
        return out


class _BatchReader(_Log, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.ranges({}, self.ends()) or [ShardRange(0, 0, 0, ())]

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.names)


class _StreamReader(_Log, DataSourceStreamReader):
    """The offset of a stream is a record number for each shard."""

    def initialOffset(self) -> dict:
        return {str(shard): 0 for shard in range(self.shards)}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.ranges(start, end)

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.names)


class ShardedLog(DataSource):
    """A log at ``path`` with a number of ``shards``; a shard is an input partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def read_log(spark: SparkSession, path: str, schema: StructType, shards: int, streaming: bool = False) -> DataFrame:
    """The records of a log with their shard and number, now or as a stream.

    Each shard is read by one task, from the record where the last batch ended. A
    stream that is stopped goes on from the numbers in its checkpoint.
    """
    spark.dataSource.register(ShardedLog)
    full = StructType([*schema, *StructType().add(SHARD, LongType()).add(NUMBER, LongType())])
    reader = spark.readStream if streaming else spark.read
    return reader.format(FORMAT).schema(full).option("shards", shards).load(path)

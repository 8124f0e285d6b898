"""A sink that records messages once per event key, whatever is repeated (K6, T5).

`writeStream.format("outbox")` takes messages (event_key, at, text) into a folder. A task writes its rows to a file of its own under
`messages`; only when all tasks of a batch have ended does the batch's file under `batches` name them, in one step that doesn't overwrite.
Rows of files that no batch names don't count: what a lost executor left, a second attempt of a task, an aborted batch. A batch that a restart
repeats finds its name there and leaves its new files aside. Reading keeps, of each key, its message of the earliest batch, time and text, so
keys are sent once over batches too; `deliver` keeps them from being written again within a watermark.

Defined results: messages without a key are left out; without rows there are no messages; a folder that isn't there reads as empty only through `sent`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from vacancia.streaming.limits import once

FORMAT = "outbox"
MESSAGE = "event_key string, at timestamp, text string"
_BATCH = "batch long, file string"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's file; a task without messages writes none. One batch of rows is held at a time."""
        files, at = _folder(self.path)
        name, rows, out = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            batch = batch.filter(batch.column("event_key").is_valid())
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(f"{at}/messages", recursive=True)
                out = pq.ParquetWriter(f"{at}/messages/{name}", batch.schema, filesystem=files)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """Names the batch's files. The name is written in full beside its place and moved there, so a batch is there whole or not at all."""
        files, at = _folder(self.path)
        place = f"{at}/batches/{batchId}.parquet"
        if files.get_file_info(place).type != fs.FileType.NotFound:
            return  # a restart repeats a batch that was committed
        named = [m.file for m in messages if m is not None and m.file]
        files.create_dir(f"{at}/batches", recursive=True)
        draft = f"{at}/batches/_{batchId}-{uuid.uuid4().hex}"
        pq.write_table(pa.table({"batch": pa.array([batchId] * len(named), pa.int64()), "file": pa.array(named, pa.string())}), draft, filesystem=files)
        files.move(draft, place)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """Removes the files of tasks that had ended; those of others are never named."""
        files, at = _folder(self.path)
        for m in messages:
            if m is not None and m.file and files.get_file_info(f"{at}/messages/{m.file}").type != fs.FileType.NotFound:
                files.delete_file(f"{at}/messages/{m.file}")


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self.options["path"])


def record(messages: DataFrame, folder: str, state: str) -> None:
    """Records a stream's messages that there are now in a folder that all hosts share; `sent` settles keys that come again."""
    spark = messages.sparkSession
    spark.dataSource.register(Outbox)
    rows = messages.select("event_key", F.col("at").cast("timestamp").alias("at"), "text")
    rows.writeStream.format(FORMAT).option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def deliver(messages: DataFrame, folder: str, state: str, within: str = "1 hour") -> None:
    """The same of messages whose key hasn't come within the watermark, so a repeated key isn't written while its state lasts."""
    rows = messages.select("event_key", F.col("at").cast("timestamp").alias("at"), "text").where("event_key is not null")
    record(once(rows, "event_key", "at", within), folder, state)


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """(event_key, batch, at, text) of the messages of committed batches, one a key."""
    files, at = _folder(folder)
    if files.get_file_info(f"{at}/messages").type == fs.FileType.NotFound or files.get_file_info(f"{at}/batches").type == fs.FileType.NotFound:
        return spark.createDataFrame([], "event_key string, batch long, at timestamp, text string")
    batches = spark.read.schema(_BATCH).parquet(f"{folder}/batches")
    messages = spark.read.schema(MESSAGE).parquet(f"{folder}/messages").select("*", F.col("_metadata.file_name").alias("file"))
    return messages.join(batches, "file").groupBy("event_key").agg(F.min(F.struct("batch", "at", "text")).alias("m")).select("event_key", "m.*")

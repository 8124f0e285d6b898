"""Exports of whole inventories as JSON arrays, a data source: read as they are decoded, refused unless whole.

`spark.read.format("json_export").schema(...).load(folder)` gives a row per object of each file. A file is one array, gzipped or not (by its first
bytes); files are partitions. A task holds a chunk of text, the object it is at and a batch of rows, never an array.

A file is refused, which fails the read, if it is empty, if its bytes aren't UTF-8 or its gzip is cut short, if anything but objects stands in
the array, if an object is longer than MOST_ITEM characters, if the array isn't closed or if something follows it. White space and a byte order
mark are skipped, commas between objects aren't asked for. Values follow the schema: a missing member, a null or a value of another kind is null; nested values
of a string column come as JSON text; half surrogate pairs become question marks; members beyond the schema are skipped. A whole but empty array gives no rows.

`write` stores rows as such arrays, one a partition, in one pass, and an empty one before them, as Spark writes an empty first file where its first partition has no rows.
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

FORMAT = "json_export"
# Fixed value: characters of the longest object.
MOST_ITEM = 2_000_000
CHUNK, BATCH = 1 << 16, 1000
_SPACE = " \t\r\n"
_BITS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


class BrokenExport(ValueError):
    """An export that isn't a whole array of objects."""


def unzipped(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of what may be gzip, of several members too; it must end where a member ends."""
    decoder, zipped, head = None, None, b""
    for chunk in chunks:
        if zipped is None:
            head += chunk
            if len(head) < 2:
                continue
            zipped, chunk = head[:2] == b"\x1f\x8b", head
        if not zipped:
            yield chunk
            continue
        while chunk:
            if decoder is None or decoder.eof:
                decoder = zlib.decompressobj(31)
            piece = decoder.decompress(chunk, 16 * CHUNK)  # a bounded piece at a time, whatever the compression
            while piece:
                yield piece
                piece = decoder.decompress(decoder.unconsumed_tail, 16 * CHUNK)
            chunk = decoder.unused_data
    if zipped is None:
        yield head
    elif zipped and not decoder.eof:
        raise BrokenExport("the gzip is cut short")


def decoded(chunks: Iterable[bytes]) -> Iterator[str]:
    """The text of UTF-8 bytes; characters may span chunks."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    for chunk in chunks:
        if text := decoder.decode(chunk):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def objects(texts: Iterable[str], most: int = MOST_ITEM) -> Iterator[dict]:
    """The objects of one JSON array that comes in pieces; BrokenExport where it is no whole array of objects."""
    scan, held, state = json.JSONDecoder().raw_decode, "", "before"
    skipped = {"before": _SPACE + "\ufeff", "in": _SPACE + ",", "after": _SPACE}
    wait = 0  # an object that didn't end is tried again once the text has doubled, so a long one costs no square
    for text in chain(texts, [None]):
        held += text or ""
        if text is not None and len(held) < wait:
            continue
        at, wait = 0, 0
        while True:
            while at < len(held) and held[at] in skipped[state]:
                at += 1
            if at == len(held):
                break
            if state == "before":
                if held[at] != "[":
                    raise BrokenExport("no array begins")
                state, at = "in", at + 1
                continue
            if state == "after":
                raise BrokenExport("data follows the array")
            if held[at] == "]":
                state, at = "after", at + 1
                continue
            if held[at] != "{":
                raise BrokenExport("an item is no object")
            try:
                item, end = scan(held, at)
            except RecursionError:
                raise BrokenExport("an item is nested too deep") from None
            except json.JSONDecodeError:
                if text is None:
                    raise BrokenExport("an item is cut short or no JSON") from None
                item, end = None, len(held)
            if end - at > most:
                raise BrokenExport("an item is too long")
            if item is None:
                wait = min(2 * (end - at), most + 1)
                break
            yield item
            at = end
        held = held[at:]
    if state != "after":
        raise BrokenExport("the array isn't closed" if state == "in" else "nothing is there")


def value(found: object, kind: DataType) -> object:
    """A JSON value as a value of a column, null where it is of another kind."""
    if found is None:
        return None
    if isinstance(kind, StringType):
        text = found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)
        return text.encode("utf-8", "replace").decode()
    if isinstance(kind, BooleanType):
        return found if isinstance(found, bool) else None
    if type(kind) in _BITS:
        whole = isinstance(found, int) and not isinstance(found, bool)
        return found if whole and -(1 << _BITS[type(kind)] - 1) <= found < 1 << _BITS[type(kind)] - 1 else None
    if isinstance(kind, (DoubleType, FloatType)):
        return float(found) if isinstance(found, (int, float)) and not isinstance(found, bool) and abs(found) < 1e308 else None
    if isinstance(kind, ArrayType):
        return [value(v, kind.elementType) for v in found] if isinstance(found, list) else None
    if isinstance(kind, StructType):
        return {f.name: value(found.get(f.name), f.dataType) for f in kind} if isinstance(found, dict) else None
    raise TypeError(f"no column of {kind.simpleString()} in an export")


def _chunks(path: str) -> Iterator[bytes]:
    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_stream(at, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


class _Files(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self) -> list[InputPartition]:
        """A file each; names that begin with a dot or an underscore are left out."""
        files, at = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(at))
        root = self.path if info.is_file else self.path.rstrip("/") + "/"
        return [InputPartition(root if info.is_file else root + f.base_name) for f in found if f.is_file and f.base_name[0] not in "._"]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        kind, rows = to_arrow_schema(self.schema), []
        batch = lambda: pa.RecordBatch.from_pylist(rows, kind)
        try:
            for item in objects(decoded(unzipped(_chunks(partition.value)))):
                rows.append({f.name: value(item.get(f.name), f.dataType) for f in self.schema})
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        except (BrokenExport, UnicodeDecodeError, zlib.error) as e:
            raise BrokenExport(f"malformed export {partition.value}: {e}") from e
        if rows:
            yield batch()


class JsonExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("state the schema of an export")

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return _Files(schema, path if "://" in path or path.startswith("file:") else f"file://{path}")


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The objects of an export's file, or of a folder of such files."""
    spark.dataSource.register(JsonExport)
    return spark.read.format(FORMAT).schema(schema).load(path)


def write(rows: DataFrame, path: str) -> None:
    """Rows as gzipped JSON arrays, one a partition, in a new folder; nulls are left out of objects. A task holds a batch of rows."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for frame in frames:
            values = frame["value"].tolist()
            yield pd.DataFrame({"value": [(mark if not i else ",") + v for i, v in enumerate(values)]})
            mark = "," if values else mark
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    arrays = rows.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(lines, "value string")
    rows.sparkSession.range(0, 1, 1, 1).select(F.lit("[]").alias("value")).union(arrays).write.option("compression", "gzip").text(path)

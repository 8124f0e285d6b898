"""Helpers that the training-data operators share: table reading, checkpoints, Arrow mapping, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the cluster's shared checkpoint folder. A temporary one serves a local session alone, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


_kept: dict[int, object] = {}
_used: set[int] = set()


def per_worker(key: str, make: Callable[[], object]) -> object:
    """One object for all tasks of a Python worker, as long as these are of one operator."""
    k = hash(key)
    _used.add(k)
    if k not in _kept:
        _kept[k] = make()
    return _kept[k]


def drop_unused() -> None:
    """Lets go of what the task that begins doesn't use: workers outlive stages, and caches of one would lie beside those of the next."""
    for k in set(_kept) - _used:
        del _kept[k]
    _used.clear()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array] | None]], schema: str) -> DataFrame:
    """Maps record batches to columns of ``schema``; ``make`` runs once per task and returns the function for a batch."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        drop_unused()
        for batch in batches:
            columns = step(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one at a time, a null as empty."""
    for value in column:
        yield value.as_py() or ""


def filter_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Keeps the rows for which the batch function says so; every column passes through untouched, whatever its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        drop_unused()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_groups(df: DataFrame, keys: list[str], step: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...] | None], schema: str) -> DataFrame:
    """Maps each group of rows with equal ``keys`` (longs) to columns of ``schema``, many small groups in one pass of a task.

    ``df`` is dealt by its keys and sorted within partitions; a task holds one group and one batch. ``step`` gets a group's columns as arrays, and isn't
    asked about groups of a single row. The count of partitions is stated, so that adaptive execution doesn't join them by their bytes: the work isn't in them.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unused()
        held: list[list[np.ndarray]] = []  # what is seen of the last group

        def whole(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*parts)] if len(parts) > 1 else parts[0]

        def results(columns: list[np.ndarray], bounds: list[int]) -> pa.RecordBatch | None:
            found = [step({n: c[a:b] for n, c in zip(names, columns)}) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
            found = [f for f in found if f is not None]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), fields)], schema=fields) if found else None

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            key = [columns[names.index(k)] for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            same = bool(held) and all(held[-1][names.index(k)][-1] == c[0] for k, c in zip(keys, key))
            if held and (not same or len(new)):
                last = whole([*held, [c[: new[0]] for c in columns]] if same else held)
                if (out := results(last, [0, len(last[0])])) is not None:
                    yield out
                held = []
            starts = [*([] if same else [0]), *new.tolist()]
            if len(starts) > 1 and (out := results(columns, starts)) is not None:
                yield out
            held.append([c[starts[-1] :] for c in columns] if starts else columns)
        if held:
            last = whole(held)
            if (out := results(last, [0, len(last[0])])) is not None:
                yield out

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, group: str, most: Column) -> DataFrame:
    """Of (row, group), row a hash that names a row, for each group at most ``most`` distinct rows, those that a second hash puts first.

    The rows are first cut down to about twice as many by that hash, at a share that follows from how many distinct ones
    the group has, so what the ranking brings together is of bounded size itself, however often a row is repeated.
    """
    span = float(1 << 30)
    sizes = rows.groupBy(F.col(group).alias("of")).agg(F.approx_count_distinct("row").alias("count"))
    near = rows.join(sizes, F.col(group) == F.col("of")).withColumn("hash", F.pmod(F.xxhash64("row"), F.lit(int(span))))
    near = near.where(F.col("hash") < F.lit(span) * (2 * most + 64) / F.col("count")).dropDuplicates([group, "row"])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("hash", "row")))
    return ranked.where(F.col("rank") <= most).select("row", group)


#: Edges that a task contracts on its own.
LOCAL_EDGES = 100_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b), b the smallest node that a reaches within its part: the same components, of fewer edges; a star forest if there is one part."""
    fields = to_arrow_schema(edges.schema)
    # structs compare field by field, nulls first
    comparable = lambda x: tuple((v is not None, v) for v in x.values()) if isinstance(x, dict) else x
    plain = lambda x: tuple(v for _, v in x) if isinstance(x, tuple) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def least(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = least(comparable(a)), least(comparable(b))
                above[max(x, y)] = min(x, y)
        stars = [(x, least(x)) for x in above]
        stars = [(plain(x), plain(y)) for x, y in stars if x != y]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stars), fields)], schema=fields)

    return edges.coalesce(parts).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b of one type), component the smallest node reachable.

    Edges are contracted within parts of about LOCAL_EDGES; if there is more than one part, alternating large-star and small-star rounds follow: each is a
    join with the per-node minimum, a map-side-combined aggregate, so a hub of any degree is never gathered into one group. An edge
    set is a star forest when a round leaves it unchanged. Empty edges give an empty result.
    """
    current = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = -(-current.count() // LOCAL_EDGES)
    if parts:
        current = checkpoint(_contracted(current, parts))
    if parts > 1:
        current = _star_rounds(current)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())


def _star_rounds(current: DataFrame) -> DataFrame:
    """The star forest of edges (a, b), a above b."""
    current = checkpoint(current.distinct())
    before = _digest(current)
    while before[0]:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(least, large.a == least.n)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.where("b = m").select("a", "b")).distinct()
        current = checkpoint(small)
        after = _digest(current)
        if after == before:
            break
        before = after
    return current


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

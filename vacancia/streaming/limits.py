"""Streaming operators: request budgets, late rows, once-only events, incremental evaluation."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Granted requests within seconds, by category.
BUDGETS = {"rss": (100, 60), "metadata": (100, 3600), "feed": (90, 3600)}
#: Requests that are judged and given on at a time.
PIECE = 20_000


def grant(times: list[float], log: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which requests a sliding log grants; denied ones leave no trace. Times ascend."""
    out, held = [], deque(log)
    for t in times:
        while held and not held[0] > t - window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, list(held)


def _seconds(times: np.ndarray) -> list[float]:
    """Times as seconds, nulls as no number."""
    micros = times.astype("datetime64[us]")
    return np.where(np.isnat(micros), np.nan, micros.astype("int64") / 1e6).tolist()


def request_budget(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(key, id, ts, granted) of a stream of requests (key, id, ts): at most ``limit`` granted within any window.

    The state of a key is its log of granted times, never more than ``limit`` of them. A batch's requests of a key are held as two arrays while
    they are put in order, 25 bytes a request, and judged and given on in pieces.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        held = [(f["id"].to_numpy().copy(), f["ts"].to_numpy().copy()) for f in frames]
        ids, times = (np.concatenate(columns) for columns in zip(*held))
        del held
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        del order
        granted = np.empty(len(ids), bool)
        for i in range(0, len(ids), PIECE):
            granted[i : i + PIECE], log = grant(_seconds(times[i : i + PIECE]), log, limit, seconds)
        state.update((log,))
        for i in range(0, len(ids), PIECE):
            yield pd.DataFrame({"key": key[0], "id": ids[i : i + PIECE], "ts": times[i : i + PIECE], "granted": granted[i : i + PIECE]})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, id long, ts timestamp, granted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def batch_request_budget(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The same over a table. A key's requests are read in order; a task holds a batch and the log of the key it is at, not the key's rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, log = None, []
        for frame in frames:
            granted = []
            for key, rows in frame.groupby("key", sort=False, dropna=False):
                if not (key == at or pd.isna(key) and at is not None and pd.isna(at)):
                    at, log = key, []
                own, log = grant(_seconds(rows["ts"].to_numpy()), log, limit, seconds)
                granted += own
            yield frame.assign(granted=granted)

    ordered = requests.select("key", "id", "ts").repartition("key").sortWithinPartitions("key", "ts", "id")
    return ordered.mapInPandas(run, "key string, id long, ts timestamp, granted boolean")


def split_late(rows: DataFrame, cursor: datetime, column: str = "first_seen_at") -> tuple[DataFrame, DataFrame]:
    """Rows from the cursor on, and the historical ones before it."""
    return rows.where(F.col(column) >= F.lit(cursor)), rows.where(F.col(column) < F.lit(cursor))


def once(events: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Events whose key has not come within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now into a table of a folder, and reads it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a stream, on what all hosts share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        folder = tempfile.mkdtemp(prefix="streams")
    return f"{folder}/{name}-{uuid.uuid4()}"


def each_batch(stream: DataFrame, folder: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Applies a function to each micro-batch of what there is now; batches that a restart repeats have the same number."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def next_deliveries(deliveries: DataFrame, candidates: DataFrame, now: datetime, paused: bool) -> DataFrame:
    """Deliveries after one cycle's dispatch, as a set: (opportunity_id, status, event_key, message_text).

    New candidates are queued (or skipped while paused); queued ones take new content; failed ones take
    its key alone; pending, sent and skipped ones stand. While paused, whatever is queued is skipped.
    """
    new = candidates.select("opportunity_id", F.col("event_key").alias("new_key"), F.col("message_text").alias("new_text"))
    joined = deliveries.join(new, "opportunity_id", "full_outer")
    fresh = F.col("new_key").isNotNull() & (F.col("event_key").isNull() | (F.col("event_key") != F.col("new_key")))
    open_ = F.col("status").isNull() | F.col("status").isin("queued", "failed")
    waiting = F.col("status").isNull() | (F.col("status") == "queued")
    status = F.when(waiting & F.lit(paused), "skipped_paused").when(F.col("status").isNull(), "queued").otherwise(F.col("status"))
    return joined.select(
        "opportunity_id", status.alias("status"), F.when(fresh & open_ & ~F.lit(paused) | F.col("event_key").isNull(), F.col("new_key")).otherwise(F.col("event_key")).alias("event_key"),
        F.when(fresh & waiting & ~F.lit(paused) | F.col("status").isNull(), F.col("new_text")).otherwise(F.col("message_text")).alias("message_text"),
    )

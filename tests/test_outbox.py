"""The sink of messages: once a key over batches, restarts, repeated batches, lost attempts and aborts."""

import datetime as dt
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import rows
from vacancia.plans import QUERIES
from vacancia.streaming import outbox

START = dt.datetime(2026, 1, 5)


def put(spark, folder, messages):
    spark.createDataFrame(messages, outbox.MESSAGE).coalesce(2).write.mode("append").parquet(str(folder))


def test_each_key_is_sent_once_over_batches_and_restarts(spark, tmp_path):
    r = random.Random(3)
    seen = {}
    for k in range(3):
        part = [(r.choice([f"k{r.randint(0, 40)}", None]), START + dt.timedelta(minutes=k * 3, seconds=r.randint(0, 100)), f"text {k} {i}") for i in range(60)]
        put(spark, tmp_path / "in", part)
        for key in {m[0] for m in part} - {None}:
            seen.setdefault(key, k)
        outbox.deliver(spark.readStream.schema(outbox.MESSAGE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {m["event_key"]: m["text"] for m in outbox.sent(spark, str(tmp_path / "out")).collect()}
    assert {key: int(text.split()[1]) for key, text in found.items()} == seen


def test_a_key_beyond_the_watermark_still_counts_once(spark, tmp_path):
    for day in (0, 1, 2):
        put(spark, tmp_path / "in", [("a", START + dt.timedelta(days=day), f"day {day}"), (f"b{day}", START + dt.timedelta(days=day), "b")])
        outbox.deliver(spark.readStream.schema(outbox.MESSAGE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), "1 minute")
    assert spark.read.parquet(str(tmp_path / "out" / "messages")).where("event_key = 'a'").count() == 2  # day 1 meets the state of day 0, day 2 meets none
    assert {(m["event_key"], m["text"]) for m in outbox.sent(spark, str(tmp_path / "out")).collect()} == {("a", "day 0"), ("b0", "b"), ("b1", "b"), ("b2", "b")}


class Task:
    partitionId = staticmethod(lambda: 0)


@pytest.fixture
def writer(tmp_path, monkeypatch):
    monkeypatch.setattr(outbox.TaskContext, "get", staticmethod(lambda: Task))
    return outbox._Writer(str(tmp_path))


def batch(*keys):
    return iter([pa.record_batch({"event_key": pa.array(keys, pa.string()), "at": pa.array([START] * len(keys), pa.timestamp("us", "UTC")), "text": pa.array(["t"] * len(keys), pa.string())})])


def test_only_committed_files_count(spark, tmp_path, writer):
    assert outbox.sent(spark, str(tmp_path)).count() == 0
    first, attempt, empty = writer.write(batch("a", None)), writer.write(batch("lost")), writer.write(batch(None))
    assert (first.rows, empty.file) == (1, None)
    writer.commit([first, empty, None], 0)
    writer.commit([attempt], 0)  # a repeated batch changes nothing
    aborted = writer.write(batch("b"))
    writer.abort([aborted, None, empty], 1)
    writer.abort([aborted], 1)
    writer.commit([writer.write(batch("b", "a"))], 1)
    writer.commit([], 2)
    assert rows(outbox.sent(spark, str(tmp_path)).select("event_key", "batch")) == [("a", 0), ("b", 1)]
    assert pq.read_table(tmp_path / "batches" / "1.parquet").num_rows == 1 and not (tmp_path / "messages" / aborted.file).exists()


def test_a_failed_task_leaves_its_batch_out_until_it_is_repeated(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", [("a", START, "1"), ("b", START, "2")])
    stream = lambda: spark.readStream.schema(outbox.MESSAGE).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        outbox.deliver(stream().withColumn("text", outbox.F.expr("if(event_key = 'b', cast(1 / 0 as string), text)")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert outbox.sent(spark, str(tmp_path / "out")).count() == 0
    outbox.deliver(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(outbox.sent(spark, str(tmp_path / "out")).select("event_key", "text")) == [("a", "1"), ("b", "2")]


def test_query_on_a_small_table(spark):
    found = QUERIES["k6_sent_messages"](spark, "/root/testdata/sf0.001").collect()
    assert found and len({r["event_key"] for r in found}) == len(found)
    assert json.dumps([r["text"] for r in found])

"""Alerts of source runs: stated cases, streams against replays, and both against SQL (in test_queries)."""

import datetime as dt
import random

import pytest
from pyspark.sql.functions import lit

from tests.conftest import rows
from vacancia.plans import QUERIES
from vacancia.streaming import alerts, deliveries, limits

START = dt.datetime(2026, 1, 5)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", deliveries.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def walked(statuses, delivered=(), limits_=(), counts=()):
    """The event of each run of a new source."""
    pick = lambda values, i, default: values[i] if i < len(values) else default
    state, out = alerts._NEW, []
    for i, s in enumerate(statuses):
        run = {"at_us": i, "id": i, "status": s, "limit_reached": pick(limits_, i, False), "discovered_count": pick(counts, i, 100), "delivered": pick(delivered, i, True)}
        state, _, event = alerts.step(state, run)
        out.append(event)
    return out, state


F, P, S = "failed", "partial", "succeeded"


@pytest.mark.parametrize(
    ("statuses", "more", "events"),
    [
        ([F, F, F, S], {}, [None, "failure", None, "recovery"]), ([F, P, P, F, F], {}, [None, None, "partial", None, "failure"]), ([F, S, F], {}, [None, None, None]),
        ([F, F, F, S, S], {"delivered": [True, False, True, False, True]}, [None, "failure", "failure", "recovery", "recovery"]),
        ([F, F, "running", F, F], {}, [None, "failure", None, None, None]), ([None, None], {}, [None, None]),
        ([S] * 5, {"limits_": [True] * 4}, [None, None, "coverage_issue", None, "coverage_recovery"]),
        ([S] * 6, {"limits_": [True] * 5, "delivered": [True, True, False, False, True, False]}, [None, None, "coverage_issue", "coverage_issue", "coverage_issue", "coverage_recovery"]),
        ([S] * 9, {"counts": [100] * 5 + [50, 50, 51, 10]}, [None] * 6 + ["coverage_issue", "coverage_recovery", None]),
        ([S] * 4, {"counts": [100, 100, 0, 0]}, [None] * 4), ([S] * 7, {"counts": [9] * 5 + [0, 0]}, [None] * 7), ([S] * 7, {"counts": [None] * 7}, [None] * 7),
    ],
)
def test_alerts_of_runs(statuses, more, events):
    assert walked(statuses, **more)[0] == events


def test_an_undelivered_gap_waits_until_it_is_over():
    _, state = walked([S] * 3, limits_=[True] * 3, delivered=[False] * 3)
    assert (state["coverage_active"], state["coverage_reason"]) == (False, "repeated_limit")
    _, state = walked([S] * 4, limits_=[True] * 3, delivered=[False] * 4)
    assert (state["coverage_active"], state["coverage_reason"]) == (False, None)
    assert len(walked([S] * 50)[1]["counts"]) == 8


def source_runs(count, seed):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, None]), i, START + dt.timedelta(minutes=r.randint(0, 3000)), r.choice([S, S, S, S, F, F, P, "running"]), r.random() < 0.7, r.choice([100, 100, 20, None]), r.random() < 0.6) for i in range(count)]


TOLD = [(1, True, None, False, None), (2, False, None, True, "discovered_drop"), (7, True, F, True, "repeated_limit")]


def test_alert_stream_equals_replay_over_restarts_and_disorder(rocks, tmp_path):
    runs = source_runs(400, 1)
    last, told = max(r[2] for r in runs), rocks.createDataFrame(TOLD, alerts.STATE)
    for part in (runs[:150], runs[150:300], runs[300:], [(99, 9999, last + dt.timedelta(days=4), S, False, 1, True)]):
        rocks.createDataFrame(part, alerts.RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(alerts.RUN).parquet(str(tmp_path / "in"))
        found = limits.run_available(alerts.alert_log(stream, told, "3 days"), rocks, str(tmp_path / "run"))
    want = alerts.replay(rocks.createDataFrame(runs, alerts.RUN), told)
    assert rows(found) == rows(want) and found.count() == 400
    assert {r["event"] for r in want.collect()} == {None, "failure", "partial", "recovery", "coverage_issue", "coverage_recovery"}


def test_late_runs_change_nothing(rocks, tmp_path):
    run = lambda i, hours, status: (1, i, START + dt.timedelta(hours=hours), status, False, 1, True)
    for part in ([run(1, 1, F)], [run(2, 0, F)], [run(3, 2, F)]):
        rocks.createDataFrame(part, alerts.RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = limits.run_available(alerts.alert_log(rocks.readStream.schema(alerts.RUN).parquet(str(tmp_path / "in"))), rocks, str(tmp_path / "run"))
    # Spark leaves most late rows out before they come to a key
    assert {(r["run_id"], r["event"]) for r in found.collect()} - {(2, "late")} == {(1, None), (3, "failure")}


def test_replay_reads_a_source_over_many_batches(spark):
    runs, told = spark.createDataFrame(source_runs(300, 2), alerts.RUN).repartition(3), spark.createDataFrame(TOLD, alerts.STATE)
    want = rows(alerts.replay(runs, told))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(alerts.replay(runs, told)) == want and len(want) == 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert not rows(alerts.replay(runs.where("false"), told))
    assert not rows(alerts.replay(runs.withColumn("started_at", lit(None).cast("timestamp")), told))


def test_alert_queries_agree(rocks):
    assert rows(QUERIES["l13_alert_log_stream"](rocks, FOLDER)) == rows(QUERIES["l13_alert_log"](rocks, FOLDER))

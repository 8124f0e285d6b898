"""Every registered query with SQL gives what a plain SQL engine gives; the others give rows."""

import math
import os

import duckdb
import pytest

from vacancia.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    want = engine.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.take(1) and len(set(df.columns)) == len(df.columns)


def test_stream_equals_batch(spark):
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).collect())
    assert rows("t1_request_budget_stream") == rows("t1_request_budget")


def test_budget_over_many_batches(spark):
    from pyspark.sql import functions as F

    from vacancia.streaming import limits

    data = [(k, i, (i * 37 % 100) * 10) for k in ("a", "b", None) for i in range(100)]
    df = spark.createDataFrame(data, "key string, id long, s long").select("key", "id", F.timestamp_seconds("s").alias("ts")).repartition(5)
    want = {}
    for k in ("a", "b", None):
        rows = sorted((s, i) for key, i, s in data if key == k)
        want |= {(k, i): g for (_, i), g in zip(rows, limits.grant([float(s) for s, _ in rows], [], 3, 100)[0])}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r["key"], r["id"]): r["granted"] for r in limits.batch_request_budget(df, 3, 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == want and 0 < sum(want.values()) < 300

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vacancia import sources
from vacancia.functions.profile import EXAMPLE
from vacancia.operators import dedup, ingest, listings, predicates, runs
from vacancia.plans.bindings import HOSTS, Tables
from vacancia.plans.engine import TABLES, Engine
from vacancia.plans.queries_functions import RATES
from vacancia.sources import feeds, pages
from vacancia.streaming import limits

NOW = datetime(2026, 1, 31)


@pytest.fixture(scope="module")
def engine(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    return Engine(spark, {n: getattr(t, n) for n in TABLES}, EXAMPLE, HOSTS, RATES)


@pytest.mark.parametrize("sort", ["score", "newest", "company"])
def test_any_page_is_a_slice_of_all(engine, sort):
    engine.profile = type(EXAMPLE)("default", "v2", EXAMPLE.skills, ())
    whole = [r["id"] for r in engine.matches(sort=sort, limit=200).collect()]
    for offset in (0, 7, 50):
        assert [r["id"] for r in engine.matches(sort=sort, limit=20, offset=offset).collect()] == whole[offset : offset + 20]


def test_page_plan_ranks_links_of_the_page_alone(engine):
    plan = engine.jobs(limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_filters_are_checked(engine):
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"q": "x"}):
        with pytest.raises(ValueError):
            engine.jobs(**bad)
    with pytest.raises(ValueError):
        engine.matches(min_score=60, max_score=50)


def test_wildcards_are_ordinary_characters(spark):
    df = spark.createDataFrame([("100% remote", None), ("100 remote", None), (None, "a_b"), (None, "axb")], "title string, company string")
    found = lambda q: df.where(predicates.text_search(q, "title", "company")).count()
    assert (found("100% r"), found("A_B"), found("REMOTE")) == (1, 1, 2)


@pytest.mark.parametrize(("missing", "blocked"), [(8, False), (9, True)])
def test_reconciliation_guard(spark, missing, blocked):
    have = spark.createDataFrame([(1, str(i), True, None) for i in range(10)], "source_id long, external_id string, is_active boolean, archive_reason string")
    seen = have.where(F.col("external_id").cast("int") >= missing).select("source_id", "external_id")
    assert rows(ingest.reconcile(have, seen)) == [(1, 10, missing, blocked)]
    left = ingest.deactivate_missing(have, seen, NOW).where("is_active").count()
    assert left == (10 if blocked else 10 - missing)
    assert rows(ingest.reconcile(have, seen.where("false"))) == [(1, 10, 10, True)]


@pytest.mark.parametrize(("score", "old", "new"), [(34, False, False), (35, False, True), (54, False, True), (55, True, True)])
def test_explore_bounds(spark, score, old, new):
    df = spark.createDataFrame([(score, NOW - timedelta(days=9)), (score, NOW)], "score int, first_seen_at timestamp")
    assert [r[0] for r in df.select(predicates.explore_eligible(55, NOW - timedelta(days=1))).collect()] == [old, new]


def test_merge_and_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, note string")
    new = spark.createDataFrame([("b", "n"), ("c", "m")], "name string, note string")
    assert rows(ingest.merge(old, new, ["name"])) == [(1, "a", "x"), (2, "b", "n"), (None, "c", "m")]
    ids = ingest.surrogate_ids(spark.range(100).select((99 - F.col("id")).alias("k")), 10, "k").select("k", "id")
    assert rows(ids) == sorted(((k, k + 11) for k in range(100)), key=repr)


TEXT = "we build a data platform with python and spark for many clients around the world every day"


def opportunity(i, **changes):
    base = {"id": i, "title": "Dev (Remote)", "company": "Acme LLC", "location_text": "Kyiv", "work_mode": "remote", "published_at": NOW, "description": TEXT, "salary_min": None, "salary_max": None, "salary_currency": None, "salary_period": None}
    return tuple((base | changes).values())


OPPORTUNITY = "id long, title string, company string, location_text string, work_mode string, published_at timestamp, description string, salary_min int, salary_max int, salary_currency string, salary_period string"


@pytest.mark.parametrize(
    ("changes", "same"),
    [
        ({}, True), ({"title": "dev"}, True), ({"company": "ACME, Inc."}, True), ({"location_text": "Lviv"}, False), ({"location_text": None}, False), ({"work_mode": "hybrid"}, False), ({"published_at": NOW - timedelta(days=7)}, True), ({"published_at": NOW - timedelta(days=7, seconds=1)}, False), ({"published_at": None}, False),
        ({"description": TEXT + " extra"}, True), ({"description": TEXT * 2}, False), ({"description": "short"}, False), ({"description": TEXT.replace("python", "java").replace("spark", "flink").replace("data", "web").replace("many", "few")}, False),
    ],
)
def test_confident_pairs(spark, changes, same):
    df = spark.createDataFrame([opportunity(1), opportunity(2, **changes)], OPPORTUNITY)
    assert rows(dedup.duplicate_pairs(df)) == ([(1, 2)] if same else [])


def test_disjoint_salaries_and_currencies(spark):
    a = opportunity(1, salary_min=10, salary_max=20, salary_currency="USD")
    for changes, same in (({"salary_min": 21}, False), ({"salary_min": 20}, True), ({"salary_currency": "eur"}, False), ({"salary_currency": "usd"}, True)):
        assert dedup.duplicate_pairs(spark.createDataFrame([a, opportunity(2, **changes)], OPPORTUNITY)).count() == same


def test_greedy_merges_follow_order(spark):
    days = lambda n: NOW - timedelta(days=n)
    df = spark.createDataFrame([opportunity(1, published_at=days(0)), opportunity(2, published_at=days(6)), opportunity(3, published_at=days(12)), opportunity(4, published_at=days(0))], OPPORTUNITY)
    owners = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "opportunity_id long, source_id long")
    # 2 goes to 1, so 3 (too far from 1) stays; 4 shares a source with 1
    assert rows(dedup.greedy_merges(df, owners)) == [(2, 1)]


def run(i, status="succeeded", count=100, limit=False, source=1):
    return (i, source, status, NOW + timedelta(hours=i), NOW + timedelta(hours=i, minutes=1), count, limit, 0, 0)


RUN = "id long, source_id long, status string, started_at timestamp, finished_at timestamp, discovered_count int, limit_reached boolean, error_count int, detail_failure_count int"
STATE = "id long, failure_alert_active boolean, failure_alert_reason string, coverage_alert_active boolean, pending_reason string"


@pytest.mark.parametrize(
    ("history", "state", "event"),
    [
        ([run(1), run(2, "failed")], (1, False, None, False, None), None), ([run(1, "failed"), run(2, "failed")], (1, False, None, False, None), "failure"), ([run(1, "partial"), run(2, "partial")], (1, False, None, False, None), "partial"),
        ([run(1, "failed"), run(2, "failed")], (1, True, "failed", False, None), None), ([run(1, "failed"), run(2)], (1, True, "failed", False, None), "recovery"),
        ([*map(run, range(1, 7)), run(7, count=20), run(8, count=20)], (1, False, None, False, None), "coverage_issue"), ([*map(run, range(1, 7)), run(7, count=20), run(8, count=51)], (1, False, None, False, None), None),
        ([*map(run, range(1, 6)), run(6, count=20), run(7, count=20), run(8, count=20)], (1, False, None, False, None), None), ([*map(run, range(1, 6)), run(6, count=20), run(7, count=20), run(8, count=20)], (1, False, None, False, "discovered_drop"), "coverage_issue"),
        ([run(i, limit=True) for i in range(1, 4)], (1, False, None, False, None), "coverage_issue"), ([run(1), run(2)], (1, False, None, True, None), "coverage_recovery"),
    ],
)
def test_health_events(spark, history, state, event):
    found = runs.health_events(spark.createDataFrame(history, RUN), spark.createDataFrame([state], STATE)).collect()
    assert [r["event"] for r in found] == [event]


def test_jitter_stays_in_range(spark):
    df = spark.range(200).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("n"), F.lit(NOW).alias("t"))
    got = [r[0] for r in df.select(predicates.jittered_seconds(F.col("n"), F.col("t"), 1000, 0.15)).collect()]
    assert min(got) >= 850 and max(got) <= 1150 and len(set(got)) > 50


RSS = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>Engineer в Acme, $1000</title><link>https://jobs.example/vacancies/11/</link><description>Text</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0200</pubDate></item>
<item><title>Tester</title><link>https://jobs.example/vacancies/12</link></item><item><title>Copy</title><link>https://jobs.example/vacancies/12</link></item>
<item><title>Bad</title><link>http://jobs.example/vacancies/13</link></item></channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    found = feeds.postings(feeds.read_feed(spark, str(tmp_path)), ("jobs.example",)).orderBy("external_id").collect()
    assert [(r["external_id"], r["title"], r["company"], r["details"]) for r in found][0] == ("11", "Engineer", "Acme", "$1000")
    assert [r["external_id"] for r in found] == ["11", "12"] and str(found[0]["published_at"]) == "2026-01-05 08:00:00"


def test_export_must_be_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Id":"1","Name":"Python dev","CityId":7,"RubricId":[3]},{"Id":"2","Name":"Cook"}]')
    rows_ = pages.read_export(spark, str(tmp_path / "a.json"))
    assert [r["Id"] for r in pages.export_candidates(rows_, (3,), ("python",), 7).collect()] == ["1"]
    (tmp_path / "b.json").write_text('[{"Id":"1"},{"Id":')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        pages.read_export(spark, str(tmp_path / "b.json")).collect()


def test_cards(spark):
    html = '<div class="card x"><a href="/1"><b class=t>One</b></a><p class="pay">10</p></div><p>out</p><div class=card><span class=t>Two <i>b</i></span></div>'
    found = pages.html_cards(spark.createDataFrame([(1, html), (2, None)], "k long, html string"), "k", "card", {"title": "t", "salary": "pay"})
    assert rows(found) == [(1, 0, "/1", "One", "10"), (1, 1, None, "Two b", None)]


def test_json_ld(spark):
    page = '<script type="application/ld+json">[{"@type":"JobPosting","title":"A","jobLocation":{"address":"x"}},{"@type":"Other"}]</script><script type=\'application/ld+json\'>{"@type":["X","JobPosting"],"title":"B","identifier":"7"}</script><script type="application/ld+json">{bad</script>'
    found = pages.posting_fields(pages.json_ld(spark.createDataFrame([(page,)], "html string")))
    assert rows(found.select("title", "external_id", "work_mode")) == [("A", None, "onsite"), ("B", "7", "unknown")]


def test_batches_rotate(spark):
    df = spark.range(10).withColumnRenamed("id", "position")
    batch = lambda k: [r["position"] for r in feeds.search_batch(df, 4, k, 2, 10).collect()]
    assert batch(0) == [0, 1, 2, 3] and batch(1) == [0, 1, 4, 5] and batch(4) == [0, 1, 2, 3]
    assert feeds.ordered_distinct([["a", "B "], ["b", "c", " "]]) == ["a", "B", "c"]


def test_between(spark):
    df = spark.createDataFrame([("x START one\ntwo END y",), ("START rest",), ("none",)], "t string")
    assert [r[0] for r in df.select(pages.between(F.col("t"), "START", "END")).collect()] == ["one\ntwo", "rest", None]


def test_registry(spark):
    a, b = (sources.static_source(n, [("1", "https://x/", "{}", None, True)]) for n in "ab")
    assert [s.name for s in sources.registry([a, b], ["b"])] == ["b"] and b.fetch(spark).count() == 1


def test_denied_requests_leave_no_trace():
    granted, log = limits.grant([0, 1, 2, 59, 60, 61, 62], [], 2, 60)
    assert granted == [True, True, False, False, True, True, False] and log == [60, 61]


def test_dispatch(spark):
    known = spark.createDataFrame([(1, "queued", "k1", "m1"), (2, "failed", "k2", "m2"), (3, "sent", "k3", "m3"), (4, "queued", "k4", "m4")], "opportunity_id long, status string, event_key string, message_text string")
    new = spark.createDataFrame([(i, f"n{i}", f"t{i}") for i in (1, 2, 3, 5)], "opportunity_id long, event_key string, message_text string")
    assert rows(limits.next_deliveries(known, new, NOW, False)) == [(1, "queued", "n1", "t1"), (2, "failed", "n2", "m2"), (3, "sent", "k3", "m3"), (4, "queued", "k4", "m4"), (5, "queued", "n5", "t5")]
    assert [r[1] for r in rows(limits.next_deliveries(known, new, NOW, True))] == ["skipped_paused", "failed", "sent", "skipped_paused", "skipped_paused"]


def test_once(spark, tmp_path):
    spark.createDataFrame([("a", NOW), ("a", NOW), ("b", NOW)], "key string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    assert limits.run_available(limits.once(stream, "key", "ts", "1 hour"), spark, str(tmp_path)).count() == 2


def test_refresh_marks_stale(spark, engine):
    found = listings.refresh_canonical(engine["opportunities"], engine["listings"], engine["sources"])
    assert found.where("status = 'stale' and canonical_listing_id is not null or status = 'active' and canonical_listing_id is null").count() == 0

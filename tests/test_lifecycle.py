"""Splitting, deliveries, merges and runs against sequential brute force."""

import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vacancia.operators import dedup, intake, lineage
from vacancia.operators.lineage import components
from vacancia.plans import QUERIES
from vacancia.sources import splitting, static_source
from vacancia.streaming import deliveries, limits

FOLDER = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def split_one_by_one(items, full, most):
    """Parts as a traversal asks for them one after another."""
    out = []

    def visit(category, experience, english, by_category, held, level):
        if not held:
            return
        below, state = [], "leaf"
        if len(held) >= full:
            state = "overflow"
            if category is None and by_category:
                named = sorted({c for r in held for c in r[1] or [] if c.strip()})
                if len(named) <= most:
                    state = "split"
                    below = [(c, None, None, True, [r for r in held if c in (r[1] or [])], 0) for c in named]
                    if any(not [c for c in r[1] or [] if c.strip()] for r in held):
                        below += [(None, x, None, False, [r for r in held if r[2] == x], 1) for x in splitting.EXPERIENCE]
            elif level < 2:
                state = "split"
                values = (splitting.EXPERIENCE, splitting.ENGLISH)[level]
                below = [(category, x if level == 0 else experience, x if level == 1 else english, by_category, [r for r in held if r[2 + level] == x], level + 1) for x in values]
        found = {r[0] for b in below for r in b[4]}
        out.append((category, experience, english, by_category, len(held), state, len({r[0] for r in held} - found) if state == "split" else 0))
        for b in below:
            visit(*b)

    visit(None, None, None, True, items, 0)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("count", "full", "most", "bare"), [(3000, 100, 250, 0.1), (1500, 100, 250, 0), (500, 20, 3, 0.1), (50, 100, 250, 0.5), (400, 5, 250, 0.3), (0, 100, 250, 0.1), (300, 50, 250, 1)])
def test_split_equals_a_traversal(spark, count, full, most, bare):
    r = random.Random(count)
    some = lambda: None if r.random() < bare else r.choices(["a", "b", "c", "d", " "], k=r.choice([1, 1, 2]))
    items = [(i, some(), r.choice([*splitting.EXPERIENCE[:4], None, "odd"]), r.choice([*splitting.ENGLISH[:3], None])) for i in range(count)]
    df = spark.createDataFrame(items, "id long, categories array<string>, experience string, english string").repartition(3)
    assert rows(splitting.split(df, full=full, most_categories=most)) == split_one_by_one(items, full, most)


def delivery_events(count, seed, keys=(1, 2, 3, 4, 5, 6, 7, 8, None)):
    r = random.Random(seed)
    kinds = ["offer", "claim", "claim", "retry", "result", "result", "recover", "odd"]
    some = lambda i: kinds[r.randrange(8)] if r.random() < 0.97 else r.choice(["skip", "sweep"])
    at = lambda i: START + dt.timedelta(seconds=r.randint(0, 20_000), milliseconds=i % 3)
    return [(r.choice(keys), at(i), i, some(i), f"k{r.randint(0, 3)}", r.choice(["m", None]), "u", r.random() < 0.2, "e" * 2500, r.random() < 0.3, r.choice([None, None, START])) for i in range(count)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", deliveries.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_delivery_stream_equals_replay_over_restarts_and_disorder(rocks, tmp_path):
    events = delivery_events(400, 1)
    last = max(e[1] for e in events)
    parts = [events[:150], events[150:300], events[300:], [(99, last + dt.timedelta(hours=12), 9999, "odd", *(None,) * 7)]]
    for part in parts:  # each a run of its own over the state of the runs before
        rocks.createDataFrame(part, deliveries.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(deliveries.EVENT).parquet(str(tmp_path / "in"))
        found = limits.run_available(deliveries.delivery_log(stream, "10 hours"), rocks, str(tmp_path / "run"))
    passed = int((last + dt.timedelta(hours=2)).replace(tzinfo=dt.UTC).timestamp() * 1000)
    want = deliveries.replay(rocks.createDataFrame(events, deliveries.EVENT), passed)
    assert rows(found) == rows(want)
    actions = {r["action"] for r in want.collect()}
    assert {"queued", "refreshed", "rekeyed", "claimed", "deferred", "refused", "sent", "failed", "due", "kept", "ignored"} <= actions
    assert max(len(r["last_error"] or "") for r in want.collect()) == deliveries.MOST_ERROR


def test_late_delivery_events_change_nothing(rocks, tmp_path):
    late = (1, START, 1, "offer", "k", "m", "u", None, None, None, None)
    for part in ([(2, START + dt.timedelta(hours=1), 2, "offer", "k", "m", "u", None, None, None, None)], [late, (2, START + dt.timedelta(hours=2), 3, "claim", "k", "m", "u", None, None, None, None)]):
        rocks.createDataFrame(part, deliveries.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = limits.run_available(deliveries.delivery_log(rocks.readStream.schema(deliveries.EVENT).parquet(str(tmp_path / "in"))), rocks, str(tmp_path / "run"))
    assert {(r["opportunity_id"], r["action"]) for r in found.collect()} in ({(2, "queued"), (2, "claimed")}, {(1, "late"), (2, "queued"), (2, "claimed")})


def test_replay_reads_a_key_over_many_batches(spark):
    events = spark.createDataFrame(delivery_events(300, 2, (1, None)), deliveries.EVENT).repartition(3)
    want = rows(deliveries.replay(events, 1 << 60))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(deliveries.replay(events, 1 << 60)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert not rows(deliveries.replay(events.where("false"), 0))


def test_a_delivery_fails_waits_and_is_sent():
    e = lambda kind, at, **more: {"kind": kind, "at_ms": at, "seq": at, "event_key": "a", "message_text": "m", "source_url": "u", "ok": None, "error": None, "hidden": False, "recorded_ms": None} | more
    events = [e("offer", 0), e("claim", 1), e("claim", 2), e("result", 10, ok=False, error="x"), e("claim", 20), e("retry", 60_010), e("recover", 60_020), e("retry", 180_020), e("result", 180_021, ok=True), e("offer", 180_022)]
    d, log = deliveries.walk(None, events, 10**9)
    assert [(x[0], x[2], x[4]) for x in log] == [(0, "queued", 0), (1, "claimed", 0), (2, "refused", 0), (10, "failed", 1), (20, "deferred", 1), (60_010, "due", 1), (60_010, "claimed", 1), (60_020, "failed", 2), (180_020, "due", 2), (180_020, "claimed", 2), (180_021, "sent", 3), (180_022, "kept", 3)]
    assert d["status"] == "sent" and d["sent_ms"] == 180_021 and [deliveries.delay_ms(k) // 1000 for k in range(1, 9)] == [60, 120, 240, 480, 960, 1920, 3600, 3600]


def test_delivery_queries_agree(rocks):
    assert rows(QUERIES["l10_delivery_log_stream"](rocks, FOLDER)) == rows(QUERIES["l10_delivery_log"](rocks, FOLDER))


JOB = "id long, title string, company string, location_text string, work_mode string, published_at timestamp, description string, salary_currency string, salary_period string, salary_min decimal(14,2), salary_max decimal(14,2)"
WORDS = [f"word{k}" for k in range(40)]


def one_pair(x, y):
    """The pair test on plain dictionaries whose titles, companies and places are normalised already."""
    if any(not x[c] or x[c] != y[c] for c in ("title", "company", "location_text")) or x["work_mode"] == "unknown" or x["work_mode"] != y["work_mode"]:
        return False
    if x["published_at"] is None or y["published_at"] is None or abs(x["published_at"] - y["published_at"]) > dt.timedelta(days=7):
        return False
    short, long = sorted((len(x["description"] or ""), len(y["description"] or "")))
    s, t = set((x["description"] or "").split()), set((y["description"] or "").split())
    if short < 40 or long > 1.5 * short or min(len(s), len(t)) < 8 or len(s & t) / min(len(s), len(t)) < 0.8:
        return False
    low = lambda p, q: p["salary_min"] is not None and q["salary_max"] is not None and p["salary_min"] > q["salary_max"]
    return not low(x, y) and not low(y, x)


def one_by_one(jobs, listings, enabled):
    """Merges as a loop over opportunities in order makes them, each survivor refreshed from its best listing."""
    own = {j["id"]: dict(j) for j in jobs}
    first = {j["id"]: (j["title"], j["company"]) for j in jobs}
    held = {i: [x for x in listings if x["opportunity_id"] == i] for i in own}
    into = {}
    for p in sorted(own):
        for q in sorted(own):
            if q <= p or p in into or q in into or first[p] != first[q] or not all(first[p]):
                continue
            s, t = ({x["source_id"] for x in held[i]} for i in (p, q))
            if not s or not t or s & t or not one_pair(own[p], own[q]):
                continue
            into[q] = p
            held[p] = held[p] + held[q]
            fit = [x for x in held[p] if x["is_active"] and x["normalized"] and x["source_id"] in enabled]
            if fit:
                own[p] = dict(min(fit, key=lambda x: (-x["quality_score"], x["id"]))["snapshot"], id=p)
    return sorted(into.items())


def jobs_and_listings(seed, count):
    r = random.Random(seed)
    bases = [r.sample(WORDS, 20) for _ in range(3)]

    def fields():
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(20)] = r.choice(WORDS)
        return {"title": r.choice(["engineer", "engineer", "tester"]), "company": "acme", "location_text": r.choice(["kyiv", "kyiv", "kyiv", ""]), "work_mode": "remote", "published_at": r.choice([None, *[START + dt.timedelta(days=r.randint(0, 12)) for _ in range(9)]]),
                "description": " ".join(words), "salary_currency": None, "salary_period": None, "salary_min": r.choice([None, None, 5]), "salary_max": r.choice([None, None, 4, 9])}

    jobs = [{"id": i, **fields()} for i in range(count)]
    listings = [{"id": 1000 + k, "opportunity_id": r.randrange(count), "source_id": r.randrange(7), "quality_score": r.randint(1, 5), "is_active": r.random() < 0.8, "normalized": r.random() < 0.8, "snapshot": fields()} for k in range(int(count * 1.3))]
    return jobs, listings


@pytest.mark.parametrize(("seed", "component_pairs"), [(1, dedup.COMPONENT_PAIRS), (2, dedup.COMPONENT_PAIRS), (3, 0), (4, 30)])
def test_greedy_merges_equal_a_loop_with_refreshed_fields(spark, seed, component_pairs):
    jobs, listings = jobs_and_listings(seed, 60 if component_pairs > 100 else 24)
    snapshot = JOB.removeprefix("id long, ").replace(" ", ":").replace(",:", ",")
    jobs_df = spark.createDataFrame([tuple(j[f.split()[0]] for f in JOB.replace("(14,2)", "").split(", ")) for j in jobs], JOB.replace("decimal(14,2)", "int"))
    listings_df = spark.createDataFrame([tuple(x[c] for c in ("id", "opportunity_id", "source_id", "quality_score", "is_active", "normalized")) + (x["snapshot"],) for x in listings], f"id long, opportunity_id long, source_id long, quality_score long, is_active boolean, normalized boolean, snapshot struct<{snapshot.replace('decimal(14,2)', 'int')}>")
    sources = spark.createDataFrame([(k, k != 3) for k in range(7)], "id long, enabled boolean")
    want = one_by_one(jobs, listings, {0, 1, 2, 4, 5, 6})
    assert want and rows(dedup.greedy_merges(jobs_df, listings_df, sources, component_pairs)) == sorted(want, key=repr)


def test_pairs_equal_a_loop(spark):
    jobs, _ = jobs_and_listings(9, 150)
    jobs += [dict(j, id=j["id"] + 500) for j in jobs[:40]]  # copies
    df = spark.createDataFrame([tuple(j[f.split()[0]] for f in JOB.replace("(14,2)", "").split(", ")) for j in jobs], JOB.replace("decimal(14,2)", "int"))
    want = [(x["id"], y["id"]) for x in jobs for y in jobs if x["id"] < y["id"] and one_pair(x, y)]
    assert want and rows(dedup.duplicate_pairs(df)) == sorted(want, key=repr)


def test_components_of_ways_and_crowds(spark):
    way = [(i, i + 1) for i in range(100, 160)]
    crowd = [(7, i) for i in range(8, 40)]
    found = dict(tuple(r) for r in components(spark.createDataFrame([*way, *crowd, (41, 42)], "a long, b long")).collect())
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 41: 41, 42: 41}
    assert not rows(components(spark.createDataFrame([], "a long, b long")))


LISTED = "source_id long, source_name string, external_id string, source_url string, title string, company string, work_mode string, kind string, salary_currency string"


def listed(external_id="a", url="https://jobs.example/1", title="engineer", company="acme", work_mode="remote", kind="employment", currency=None, source=1):
    return (source, f"s{source}", external_id, url, title, company, work_mode, kind, currency)


@pytest.mark.parametrize(
    ("row", "fault", "reason"),
    [
        (listed(), None, None), (listed(url="https://elsewhere.example/1"), "link", "Unexpected listing URL for s1."), (listed(url=None), "link", "Unexpected listing URL for s1."), (listed(url="http://jobs.example/1"), "link", "Unexpected listing URL for s1."),
        (listed(url="http://any", source=2), None, None), (listed(external_id=None), "form", "external_id is missing"), (listed(external_id="x" * 256), "form", "external_id is too long"), (listed(title=None), "form", "title is too short"), (listed(title=""), "form", "title is too short"),
        (listed(title="x" * 500), None, None), (listed(title="x" * 501), "form", "title is too long"), (listed(company=None), None, None), (listed(company="x" * 501), "form", "company is too long"), (listed(currency="us"), "form", "salary_currency is too short"), (listed(currency="usdt"), "form", "salary_currency is too long"),
        (listed(work_mode=None), "form", "work_mode is unknown: null"), (listed(work_mode="api_key=abc123 x"), "form", "work_mode is unknown: api_key=[REDACTED] x"), (listed(kind="x" * 3000), "form", ("kind is unknown: " + "x" * 3000)[:2000]), (listed(url="x", title=""), "link", "Unexpected listing URL for s1."),
    ],
)
def test_a_listing_is_judged(spark, row, fault, reason):
    found = intake.judge(spark.createDataFrame([row], LISTED), {"s1": ("jobs.example",)}).first()
    assert (found["fault"], found["reason"]) == (fault, reason)


def run_of(spark, judged, outcomes, fetch, held, snapshots=()):
    rows_ = intake.settled(judged, spark.createDataFrame(outcomes, "source_id long, external_id string, outcome string"))
    held_df = spark.createDataFrame(held, "source_id long, external_id string, is_active boolean, archive_reason string")
    snapshots_df = spark.createDataFrame(snapshots, "source_id long, external_id string")
    state = intake.reconciled(intake.counters(rows_, spark.createDataFrame([fetch], intake.FETCH)), held_df, judged, snapshots_df)
    return intake.finished(state, START), intake.archived(held_df, state, judged, snapshots_df, START)


def fetched(**changes):
    base = {"source_id": 1, "candidates": 0, "filtered": 0, "detail_failures": 0, "metadata_deferred": 0, "pages": 1, "limit_reached": False, "warnings": None, "terminal_error": None, "deactivates": True}
    return tuple((base | changes).values())


HELD = [(1, str(k), True, None) for k in range(10)]


@pytest.mark.parametrize(
    ("shown", "fetch", "snapshot", "status", "gone"),
    [
        (range(10), {}, (), "succeeded", 0), (range(2), {}, (), "succeeded", 8), (range(1), {}, (), "failed", 0), ((), {}, (), "failed", 0), (range(2), {"limit_reached": True}, (), "succeeded", 0), (range(2), {"detail_failures": 1}, (), "succeeded", 0), (range(2), {"warnings": ["slow"]}, (), "partial", 0),
        (range(2), {"deactivates": False}, (), "succeeded", 0), (range(2), {"terminal_error": "Bearer abc"}, (), "failed", 0), (range(2), {"warnings": ["slow"]}, range(5), "partial", 5), (range(1), {}, range(1), "partial", 0), (range(3), {}, (" 7 ", ""), "succeeded", 6),
    ],
)
def test_reconciliation_after_a_run(spark, shown, fetch, snapshot, status, gone):
    judged = intake.judge(spark.createDataFrame([listed(str(k)) for k in shown], LISTED), {})
    runs, after = run_of(spark, judged, [(1, str(k), "unchanged") for k in shown], fetched(**fetch), HELD, [(1, str(k)) for k in snapshot])
    run = runs.first()
    assert (run["status"], run["deactivated"], run["discovered"]) == (status, gone, len(shown))
    left = after.where("not is_active")
    assert left.count() == gone and {r["archive_reason"] for r in left.collect()} <= {"source_closed" if snapshot else "missing"}
    if fetch.get("terminal_error"):
        assert run["error_message"] == "Bearer [REDACTED]"


def test_bad_listings_do_not_stop_a_run_and_observed_counts_agree(spark, tmp_path):
    data = [listed(str(k)) for k in range(8)] + [listed("bad", title=""), listed("far", url="http://x"), listed("far", url="http://x"), listed("lost")]
    judged = intake.judge(spark.createDataFrame(data, LISTED).repartition(3), {"s1": ("jobs.example",)})
    outcomes = [(1, str(k), ("created", "updated", "unchanged", "duplicate")[k % 4]) for k in range(8)]
    runs, _ = run_of(spark, judged, outcomes, fetched(candidates=99), [])
    run = runs.first().asDict()
    assert {k: run[k] for k in ("status", "discovered", "candidates", "created", "updated", "unchanged", "duplicate", "normalization_errors", "errors", "warning_count")} == {"status": "partial", "discovered": 12, "candidates": 99, "created": 2, "updated": 2, "unchanged": 2, "duplicate": 2, "normalization_errors": 1, "errors": 4, "warning_count": 1}
    assert run["error_message"] == "Rejected 2 listing links outside allowed source domains."
    out, seen = intake.observed(intake.settled(judged, spark.createDataFrame(outcomes, "source_id long, external_id string, outcome string")))
    out.write.parquet(str(tmp_path / "rows"))
    assert seen.get == {"discovered": 12, "rejected_links": 2, "normalization_errors": 1, "failed": 1, "created": 2, "updated": 2, "unchanged": 2, "duplicate": 2}
    assert intake.quarantine(judged).count() == 3 and intake.accepted(judged).count() == 9 and "fault" not in intake.accepted(judged).columns


def test_sources_after_their_runs(spark):
    sources = spark.createDataFrame([(k, None, None, "old") for k in range(1, 5)], "id long, last_run_at timestamp, last_success_at timestamp, last_error string")
    runs = spark.createDataFrame([(1, "succeeded", None), (2, "partial", "slow"), (3, "failed", None)], "source_id long, status string, error_message string")
    assert rows(intake.source_states(sources, runs, START)) == [(1, START, START, None), (2, START, START, "slow"), (3, START, None, "Unknown error"), (4, None, None, "old")]


def test_a_source_tells_its_metrics(spark, tmp_path):
    source = static_source("mock", [(str(k), "u", "{}", None, True) for k in range(10)])
    wanted, seen = source.fetch_observed(spark, F.col("external_id") < "4")
    wanted.write.parquet(str(tmp_path / "rows"))
    assert seen.get == {"candidates": 10, "filtered": 6} and spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_large_components_are_merged_in_rounds_of_blocks(spark):
    """A crowd of 60 copies, four sources: rounds of one step each planned ever longer and didn't end."""
    words = " ".join(WORDS[:20])
    df = spark.createDataFrame([(i, "engineer", "acme", "kyiv", "remote", START, words, None, None, None, None) for i in range(60)], "id long, title string, company string, location_text string, work_mode string, published_at timestamp, description string, salary_min int, salary_max int, salary_currency string, salary_period string")
    owners = df.selectExpr("id as opportunity_id", "id % 4 as source_id")
    found = dedup.greedy_merges(df, owners, component_pairs=300)
    assert rows(found) == sorted(((i, i - i % 4) for i in range(60) if i % 4), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fault_alone_redacts_nothing(spark):
    judged = intake.judge(spark.createDataFrame([listed("1")], LISTED), {"s1": ("jobs.example",)})
    assert "regexp_replace" not in judged.where("fault is null").select("external_id", "fault")._jdf.queryExecution().optimizedPlan().toString()


def test_listings_of_runs_are_read_and_dealt_once(spark):
    """Listings were read, aggregated and judged anew for every use."""
    held = lineage.bucketed(spark.range(50).selectExpr("id % 7 as a", "if(id % 7 = 3, null, cast(id as string)) as b", "id as n"), "a", "b")
    both = held.join(held.where("n % 2 = 0").select("a", "b", F.lit(True).alias("even")).hint("merge"), ["a", "b"], "left").groupBy("a", "b").agg(F.count("*").alias("rows"), F.max("even").alias("even"))
    assert "Exchange" not in plan_of(both)
    assert sorted((tuple(r) for r in both.collect()), key=repr) == sorted([(a, str(i), 1, True if i % 2 == 0 else None) for i in range(50) if (a := i % 7) != 3] + [(3, None, 7, None)], key=repr)
    assert not [r for r in spark.catalog.listTables() if r.name.startswith("bucketed_")]
    assert "lineitem" not in plan_of(QUERIES["l3_archived_after_runs"](spark, FOLDER))


def test_listings_of_outcomes_are_read_once(spark):
    """Listings were aggregated and shuffled anew for new ones, known ones, owners and the result; new ones took their wide columns before they were told from known ones."""
    assert "lineitem" not in plan_of(QUERIES["k3_ingest_outcomes"](spark, FOLDER))


class Held:
    """A state of a key that counts its calls."""

    def __init__(self):
        self.value, self.rows, self.timers, self.calls = None, [], [], 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return iter(self.rows) if self is self.of.lists else self.value
            if name == "registerTimer":
                self.timers.append(args[0])
            elif name == "update":
                self.value = args[0]
            else:
                self.rows = {"appendValue": [*self.rows, *args], "put": args[0] if args else [], "clear": []}[name]

        return call


def test_neighbouring_opportunities_share_calls_of_state():
    """Each opportunity had calls of its own for events, delivery and timers, and a frame."""
    handle, values, lists = Held(), Held(), Held()
    for x in (handle, values, lists):
        x.__dict__["of"] = SimpleNamespace(lists=lists)
    p = deliveries.NeighbouringDeliveries()
    p.init(SimpleNamespace(getValueState=lambda *_: values, getListState=lambda *_: lists, registerTimer=handle.registerTimer))
    r, known = random.Random(1), []
    base = {"event_key": "k", "message_text": "m", "source_url": "u", "error": "e", "hidden": False, "recorded_ms": None}
    for op in range(16):
        for seq in range(12):
            known.append(base | {"opportunity_id": op, "at_ms": 1 + r.randrange(400_000), "seq": 100 * op + seq, "kind": r.choice(["offer", "claim", "result", "retry"]), "ok": r.random() < 0.3})
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not list(p.handleInputRows(("0",), ((None, None, json.dumps(e)) for e in known), at(0))) and handle.calls + values.calls + lists.calls == 2
    found, passed = [], 0
    while passed < 4_000_000:
        passed += 200_000
        while handle.timers and min(handle.timers) <= passed:
            handle.timers = [t for t in handle.timers if t > passed]
            found += [tuple(x) for x in p.handleExpiredTimer(("0",), at(passed), None)]
    assert handle.calls + values.calls + lists.calls < 60 and not lists.rows
    want = []
    for op in range(16):
        _, log = deliveries.walk(None, sorted((e for e in known if e["opportunity_id"] == op), key=lambda e: (e["at_ms"], e["seq"])), passed)
        want += [(op, *x) for x in log]
    assert any(x[3] == "due" for x in want) and sorted(found, key=repr) == sorted(want, key=repr)
    late = list(p.handleInputRows(("0",), [(None, None, json.dumps(known[0]))], at(passed)))
    assert [(x["opportunity_id"], x["action"], x["status"]) for x in late] == [(0, "late", None)] and not lists.rows

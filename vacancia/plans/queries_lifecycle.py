"""Queries of adaptive splitting, deliveries, greedy merges and runs with isolated errors over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vacancia.operators import intake, lineage
from vacancia.plans.bindings import HOSTS
from vacancia.plans.queries_relational import SQL_ALERT, SQL_ISSUES
from vacancia.plans.registry import query
from vacancia.sources import splitting
from vacancia.streaming import alerts, deliveries, limits, outbox

_LISTED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "s4_adaptive_split",
    f"""WITH RECURSIVE i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN [] ELSE [o_orderpriority, o_orderstatus] END AS cats, list_extract({_LISTED(splitting.EXPERIENCE)}, o_orderkey % 12 + 1) AS e, list_extract({_LISTED(splitting.ENGLISH)}, o_custkey % 9 + 1) AS g FROM orders),
x AS (SELECT DISTINCT id, unnest(cats) AS cat, e, g FROM i), c AS (
SELECT 0 AS level, cat, NULL AS e, NULL AS g, true AS bycat, count(*) AS n FROM x GROUP BY cat UNION ALL SELECT 1, cat, e, NULL, true, count(*) FROM x WHERE e IS NOT NULL GROUP BY cat, e UNION ALL SELECT 2, cat, e, g, true, count(*) FROM x WHERE e IS NOT NULL AND g IS NOT NULL GROUP BY cat, e, g
UNION ALL SELECT 1, NULL, e, NULL, false, count(*) FROM i WHERE e IS NOT NULL GROUP BY e UNION ALL SELECT 2, NULL, e, g, false, count(*) FROM i WHERE e IS NOT NULL AND g IS NOT NULL GROUP BY e, g),
p AS (SELECT -1 AS level, CAST(NULL AS VARCHAR) AS cat, CAST(NULL AS VARCHAR) AS e, CAST(NULL AS VARCHAR) AS g, true AS bycat, count(*) AS n FROM i HAVING count(*) > 0
UNION ALL SELECT c.level, c.cat, c.e, c.g, c.bycat, c.n FROM p JOIN c ON p.n >= 100 AND CASE WHEN p.level = -1 THEN c.level = 0 OR (c.level = 1 AND NOT c.bycat AND EXISTS (SELECT 1 FROM i WHERE len(cats) = 0)) ELSE c.level = p.level + 1 AND c.bycat = p.bycat AND c.cat IS NOT DISTINCT FROM p.cat AND (p.level < 1 OR c.e = p.e) END)
SELECT cat AS category, e AS experience, g AS english, bycat AS by_category, n, CASE WHEN n < 100 THEN 'leaf' WHEN level < 2 THEN 'split' ELSE 'overflow' END AS state,
CASE WHEN n < 100 OR level = 2 THEN 0 WHEN level = -1 THEN (SELECT count(*) FROM i WHERE len(cats) = 0 AND e IS NULL) ELSE n - coalesce((SELECT sum(q.n) FROM c AS q WHERE q.level = p.level + 1 AND q.bycat = p.bycat AND q.cat IS NOT DISTINCT FROM p.cat AND (p.level < 1 OR q.e = p.e)), 0) END::BIGINT AS uncovered FROM p""",
)
def s4(t):
    listed = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    items = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.array("o_orderpriority", "o_orderstatus")).alias("categories"),
        listed(splitting.EXPERIENCE, F.col("o_orderkey") % 12).alias("experience"), listed(splitting.ENGLISH, F.col("o_custkey") % 9).alias("english"),
    )
    return splitting.split(items)


def _delivery_events(events):
    """Events as what happens to deliveries; three opportunities a user."""
    n = F.col("event_id")
    other = F.when(n % 6 < 2, "retry").when(n % 6 < 4, "recover").when(n % 30 == 4, "skip").when(n % 30 == 5, "sweep").otherwise("offer")
    kind = F.when(F.col("event_type") == "click", "offer").when(F.col("event_type") == "view", "claim").when(F.col("event_type").isin("purchase", "error"), "result").otherwise(other)
    at = F.col("ts").cast("timestamp")
    return events.select(
        (F.col("user_id") * 3 + n % 3).alias("opportunity_id"), at.alias("at"), n.alias("seq"), kind.alias("kind"), F.concat(F.lit("k"), (n % 5).cast("string")).alias("event_key"),
        F.when(n % 7 != 0, F.concat(F.lit("m"), n.cast("string"))).alias("message_text"), F.when(n % 11 != 0, "https://site0.example/").alias("source_url"),
        ((F.col("event_type") == "purchase") & (n % 5 == 0)).alias("ok"), F.concat(F.lit("error "), n.cast("string")).alias("error"), (n % 4 == 0).alias("hidden"), F.when(n % 8 == 2, at).alias("recorded_at"),
    )


def _plain_log(log):
    ms = [F.unix_millis(c).alias(name) for c, name in (("at", "at_ms"), ("next_attempt_at", "next_ms"), ("sent_at", "sent_ms"))]
    return log.select("opportunity_id", "seq", "action", "status", "attempts", "event_key", "message_text", "source_url", "last_error", *ms)


@query(
    "l10_delivery_log",
    f"""WITH RECURSIVE e0 AS (SELECT user_id * 3 + event_id % 3 AS op, event_id AS seq, epoch_us(ts) // 1000 AS tm, CASE WHEN event_type = 'click' THEN 'offer' WHEN event_type = 'view' THEN 'claim' WHEN event_type IN ('purchase', 'error') THEN 'result'
WHEN event_id % 6 < 2 THEN 'retry' WHEN event_id % 6 < 4 THEN 'recover' WHEN event_id % 30 = 4 THEN 'skip' WHEN event_id % 30 = 5 THEN 'sweep' ELSE 'offer' END AS kind, concat('k', event_id % 5) AS k, CASE WHEN event_id % 7 <> 0 THEN concat('m', event_id) END AS m, CASE WHEN event_id % 11 <> 0 THEN 'https://site0.example/' END AS u,
event_type = 'purchase' AND event_id % 5 = 0 AS ok, concat('error ', event_id) AS error, event_id % 4 = 0 AS hidden, CASE WHEN event_id % 8 = 2 THEN epoch_us(ts) // 1000 END AS rec FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY tm, seq) AS rn FROM e0), ends AS (SELECT max(tm) AS until FROM e0),
st AS (SELECT DISTINCT op, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS tm, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS m, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS BIGINT) AS nx, CAST(NULL AS BIGINT) AS sent, CAST(NULL AS VARCHAR) AS err FROM e
UNION ALL SELECT op, rn, tm, seq, a, CASE a WHEN 'queued' THEN 'queued' WHEN 'claimed' THEN 'pending' WHEN 'sent' THEN 'sent' WHEN 'failed' THEN 'failed' WHEN 'skipped' THEN 'skipped_paused' ELSE s END,
CASE WHEN a IN ('sent', 'failed') THEN n + 1 WHEN s IS NULL AND a IN ('queued', 'claimed', 'skipped') THEN 0 ELSE n END, CASE WHEN a IN ('queued', 'refreshed', 'rekeyed', 'deferred') OR (a = 'claimed' AND kind = 'claim') OR (a = 'skipped' AND kind = 'skip') THEN ek ELSE k END,
CASE WHEN a IN ('queued', 'refreshed') OR (a = 'claimed' AND kind = 'claim' AND (m IS NULL OR u IS NULL)) THEN em ELSE m END, CASE WHEN a IN ('queued', 'refreshed') OR (a = 'claimed' AND kind = 'claim' AND (m IS NULL OR u IS NULL)) THEN eu ELSE u END,
CASE WHEN a = 'failed' THEN tm + 1000 * least(3600, 60 * (1 << least(6, n)::INT)) WHEN a IN ('claimed', 'sent', 'skipped') THEN NULL ELSE nx END, CASE WHEN a = 'sent' THEN CASE WHEN kind = 'result' THEN tm ELSE rec END WHEN a = 'failed' THEN NULL ELSE sent END,
CASE WHEN a = 'failed' THEN CASE WHEN kind = 'result' THEN error ELSE 'Interrupted before delivery confirmation.' END WHEN a IN ('claimed', 'sent', 'skipped') THEN NULL ELSE err END FROM (
SELECT st.op, e.rn, e.tm, e.seq, e.kind, e.k AS ek, e.m AS em, e.u AS eu, e.error, e.rec, st.s, st.n, st.k, st.m, st.u, st.nx, st.sent, st.err, CASE e.kind
WHEN 'offer' THEN CASE WHEN s IS NULL THEN 'queued' WHEN s = 'queued' THEN 'refreshed' WHEN s = 'failed' THEN 'rekeyed' ELSE 'kept' END WHEN 'claim' THEN CASE WHEN s IS NULL THEN 'claimed' WHEN s NOT IN ('queued', 'failed') THEN 'refused' WHEN s = 'failed' AND nx > e.tm THEN 'deferred' ELSE 'claimed' END
WHEN 'retry' THEN CASE WHEN s IS NULL OR s NOT IN ('queued', 'failed') OR st.m IS NULL OR st.u IS NULL OR coalesce(nx > e.tm, false) OR (s = 'queued' AND e.hidden) THEN 'refused' ELSE 'claimed' END
WHEN 'result' THEN CASE WHEN s IS DISTINCT FROM 'pending' THEN 'refused' WHEN e.ok THEN 'sent' ELSE 'failed' END WHEN 'recover' THEN CASE WHEN s IS DISTINCT FROM 'pending' THEN 'refused' WHEN e.rec IS NOT NULL THEN 'sent' ELSE 'failed' END
WHEN 'skip' THEN CASE WHEN s IS NULL OR s = 'queued' THEN 'skipped' ELSE 'kept' END ELSE CASE WHEN s = 'queued' THEN 'skipped' ELSE 'kept' END END AS a FROM st JOIN e ON e.op = st.op AND e.rn = st.rn + 1) AS x),
due AS (SELECT f.op, f.nx AS tm, (SELECT max(q.rn) FROM st AS q WHERE q.op = f.op AND q.rn >= f.rn AND (q.rn = f.rn OR q.tm < f.nx)) AS rn FROM st AS f, ends WHERE f.a = 'failed' AND f.nx <= ends.until)
SELECT op AS opportunity_id, seq, a AS action, s AS status, n AS attempts, k AS event_key, m AS message_text, u AS source_url, err AS last_error, tm AS at_ms, nx AS next_ms, sent AS sent_ms FROM st WHERE rn > 0
UNION ALL SELECT st.op, NULL, 'due', st.s, st.n, st.k, st.m, st.u, st.err, due.tm, st.nx, st.sent FROM due JOIN st ON st.op = due.op AND st.rn = due.rn""",
)
def l10_log(t):
    events = _delivery_events(t.raw("events"))
    until = events.agg(F.max(F.unix_millis("at"))).first()[0]  # one number
    return _plain_log(deliveries.replay(events, until or 0))


@query("l10_delivery_log_stream")
def l10_log_stream(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", deliveries.STORE)
    stream = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return _plain_log(limits.run_available(deliveries.delivery_log(_delivery_events(stream)), t.spark, limits.run_folder(t.spark, "deliveries")))


def _finished_runs(t):
    return t.runs.where("finished_at is not null").select("source_id", "id", "started_at", "status", "limit_reached", "discovered_count", (F.col("id") % 3 != 0).alias("delivered"))


def _told(t):
    k = F.col("id")
    return t.sources.select(k.alias("source_id"), (k % 3 == 0).alias("failure_active"), F.when(k % 3 == 0, "failed").alias("failure_reason"), (k % 4 == 0).alias("coverage_active"), F.when(k % 5 == 0, "repeated_limit").alias("coverage_reason"))


def _plain_alerts(log):
    return log.withColumn("at_us", F.unix_micros("at")).drop("at")


@query(
    "l13_alert_log",
    f"""WITH RECURSIVE {SQL_ISSUES}, st AS (SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS tm, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS issue, CAST(NULL AS VARCHAR) AS event, coalesce(s.id % 3 = 0, false) AS fa, CASE WHEN s.id % 3 = 0 THEN 'failed' END AS fr, coalesce(s.id % 4 = 0, false) AS ca, CASE WHEN s.id % 5 = 0 THEN 'repeated_limit' END AS cr FROM fin LEFT JOIN sources s ON s.id = fin.source_id
UNION ALL SELECT source_id, rn, id, tm, status, issue, event, CASE WHEN event IN ('recovery', 'failure', 'partial') AND id % 3 <> 0 THEN event <> 'recovery' ELSE fa END, CASE WHEN event IN ('recovery', 'failure', 'partial') AND id % 3 <> 0 THEN CASE WHEN event <> 'recovery' THEN status END ELSE fr END,
CASE WHEN event = 'coverage_issue' THEN id % 3 <> 0 WHEN event = 'coverage_recovery' AND id % 3 <> 0 THEN false ELSE ca END, CASE WHEN event = 'coverage_issue' THEN issue WHEN (event = 'coverage_recovery' AND id % 3 <> 0) OR (status = 'succeeded' AND NOT fa AND NOT ca AND issue IS NULL) THEN NULL ELSE cr END
FROM (SELECT *, {SQL_ALERT} AS event FROM (SELECT e.source_id, e.rn, e.id, e.tm, e.status, e.before, e.issue, e.previous, st.fa, st.fr, st.ca, st.cr FROM st JOIN e ON e.source_id = st.source_id AND e.rn = st.rn + 1) AS x) AS y)
SELECT source_id, id AS run_id, epoch_us(tm) AS at_us, status, issue, event, CASE WHEN event IS NOT NULL THEN id % 3 <> 0 END AS delivered, fa AS failure_active, fr AS failure_reason, ca AS coverage_active, cr AS coverage_reason FROM st WHERE rn > 0""",
)
def l13_log(t):
    return _plain_alerts(alerts.replay(_finished_runs(t), _told(t)))


@query("l13_alert_log_stream")
def l13_log_stream(t):
    """Starts of runs come in one file, so the stream's end has passed them all."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", deliveries.STORE)
    events = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return _plain_alerts(limits.run_available(alerts.alert_log(_finished_runs(t.over(events=events)), _told(t)), t.spark, limits.run_folder(t.spark, "alerts")))


NOW = datetime(2026, 1, 1)


def _judged(t):
    """Listings by key as sources show them (``fetched``: whole runs of most sources): some links lead elsewhere, some fields have no valid form. ``is_active``: whether any of a key is."""
    key, n = ["source_id", "external_id"], F.col("quality_score")
    # keys hardly repeat: rows are dealt out as they are and sorted once
    dealt = t.listings.select(*key, F.struct("id", "source_url", "quality_score", "is_active").alias("l"), "is_active").repartition(*key)
    rows = dealt.groupBy(*key).agg(F.min("l").alias("l"), F.max("is_active").alias("is_active")).select(*key, "l.source_url", "l.quality_score", "is_active")
    listed = rows.select(
        "source_id", F.concat(F.lit("site"), F.col("source_id").cast("string")).alias("source_name"), "external_id", "source_url", F.when(n % 41 == 0, "").when(n % 43 != 0, "engineer").alias("title"), F.when(n % 47 == 0, F.repeat(F.lit("x"), F.lit(501))).otherwise("acme").alias("company"),
        F.when(n % 53 == 0, "us").when(n % 2 == 0, "usd").alias("salary_currency"), F.when(n % 59 == 0, "token=abc elsewhere").otherwise("remote").alias("work_mode"), F.lit("employment").alias("kind"), n.alias("n"),
        "is_active", F.expr("source_id % 11 <> 5 and not (source_id % 4 = 1 and quality_score % 3 = 0)").alias("fetched"),
    )
    return intake.judge(listed, HOSTS)


def _runs(t):
    held = lineage.bucketed(_judged(t).select("source_id", "external_id", "fault", "n", "is_active", "fetched"), "source_id", "external_id")
    judged = held.where("fetched").select("source_id", "external_id", "fault", "n")
    outcome = F.when(F.col("n") % 61 == 0, None).when(F.col("n") % 5 == 0, "created").when(F.col("n") % 5 == 1, "updated").when(F.col("n") % 5 == 2, "duplicate").otherwise("unchanged")
    rows = intake.settled(judged, judged.where("fault is null").select("source_id", "external_id", outcome.alias("outcome")))
    k = F.col("id")
    fetches = t.sources.select(
        k.alias("source_id"), (k * 3).alias("candidates"), (k % 5).alias("filtered"), F.when(k % 13 == 0, 2).otherwise(0).cast("long").alias("detail_failures"), F.lit(0).cast("long").alias("metadata_deferred"), (k % 3).alias("pages"), (k % 17 == 0).alias("limit_reached"),
        F.when(k % 9 == 0, F.array(F.lit("slow; token=secret"))).alias("warnings"), F.when(k % 10 == 0, "https://user:pass@host failed").alias("terminal_error"), F.lit(True).alias("deactivates"),
    )
    stored_listings = held.select("source_id", "external_id", "is_active", F.lit(None).cast("string").alias("archive_reason"))
    snapshots = stored_listings.where("source_id % 6 = 2 and external_id like '%-1'").select("source_id", "external_id")
    return judged, intake.reconciled(intake.counters(rows, fetches), stored_listings, judged, snapshots), stored_listings, snapshots


SQL_RUNS = """WITH l AS (SELECT source_id, external_id, arg_min(source_url, (id, source_url, quality_score, is_active)) AS url, arg_min(quality_score, (id, source_url, quality_score, is_active)) AS n, bool_or(is_active) AS is_active FROM listings GROUP BY source_id, external_id),
f AS (SELECT *, CASE WHEN source_id % 2 = 0 AND source_id < 60 AND NOT regexp_matches(url, concat('^(https|HTTPS)://(www\\.)?site', source_id, '\\.example(:443)?/')) THEN 'link' WHEN n % 41 = 0 OR n % 43 = 0 OR n % 47 = 0 OR n % 53 = 0 OR n % 59 = 0 THEN 'form' END AS fault FROM l WHERE source_id % 11 <> 5 AND NOT (source_id % 4 = 1 AND n % 3 = 0)),
snap AS (SELECT source_id, external_id FROM l WHERE source_id % 6 = 2 AND external_id LIKE '%-1'), g AS (SELECT l.source_id, count(*) AS active, count(*) FILTER (f.source_id IS NULL AND snap.source_id IS NULL) AS missing FROM l LEFT JOIN f USING (source_id, external_id) LEFT JOIN snap USING (source_id, external_id) WHERE l.is_active GROUP BY l.source_id),
c AS (SELECT source_id, count(*) AS discovered, count(*) FILTER (fault = 'link') AS links, count(*) FILTER (fault = 'form') AS forms, count(*) FILTER (fault IS NULL AND n % 61 = 0) AS failed, count(*) FILTER (fault IS NULL AND n % 61 <> 0 AND n % 5 = 0) AS created, count(*) FILTER (fault IS NULL AND n % 61 <> 0 AND n % 5 = 1) AS updated, count(*) FILTER (fault IS NULL AND n % 61 <> 0 AND n % 5 = 2) AS duplicate, count(*) FILTER (fault IS NULL AND n % 61 <> 0 AND n % 5 > 2) AS unchanged FROM f GROUP BY source_id),
b AS (SELECT s.id AS source_id, coalesce(discovered, 0) AS discovered, coalesce(links, 0) AS links, coalesce(forms, 0) AS forms, coalesce(failed, 0) AS failed, coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(duplicate, 0) AS duplicate, coalesce(unchanged, 0) AS unchanged, coalesce(active, 0) AS active, coalesce(missing, 0) AS missing,
s.id % 10 = 0 AS broke, s.id % 9 = 0 AS warned, EXISTS (SELECT 1 FROM snap WHERE snap.source_id = s.id) AS whole FROM sources s LEFT JOIN c ON c.source_id = s.id LEFT JOIN g ON g.source_id = s.id),
e AS (SELECT *, links + forms + failed + warned::INT + broke::INT AS errors, missing > 0 AND (missing * 5 > active * 4 OR NOT (discovered > 0 OR whole)) AS blocked FROM b),
m AS (SELECT *, CASE WHEN NOT broke THEN CASE WHEN whole THEN 'exact' WHEN errors = 0 AND source_id % 13 <> 0 AND source_id % 17 <> 0 THEN 'generic' END END AS mode, printf('Source inventory reconciliation was blocked: %d of %d active listings disappeared (%.1f%%).', missing, active, missing * 100.0 / active) AS told FROM e)"""


@query(
    "l1_source_runs",
    SQL_RUNS
    + """ SELECT source_id, CASE WHEN broke OR (blocked AND mode = 'generic') THEN 'failed' WHEN errors + (blocked AND mode IS NOT NULL)::INT > 0 THEN 'partial' ELSE 'succeeded' END AS status, discovered, greatest(source_id * 3, discovered) AS candidates, source_id % 5 AS filtered, CASE WHEN source_id % 13 = 0 THEN 2 ELSE 0 END AS detail_failures, 0 AS metadata_deferred, source_id % 3 AS pages, source_id % 17 = 0 AS limit_reached,
created, updated, unchanged, duplicate, CASE WHEN mode IS NOT NULL AND NOT blocked THEN missing ELSE 0 END AS deactivated, forms AS normalization_errors, (links > 0)::INT + warned::INT + (blocked AND mode IS NOT DISTINCT FROM 'exact')::INT AS warning_count, errors + (blocked AND mode IS NOT NULL)::INT AS errors,
nullif(CASE WHEN broke THEN 'https://user:[REDACTED]@host failed' WHEN blocked AND mode = 'generic' THEN told ELSE concat_ws('; ', CASE WHEN links > 0 THEN concat('Rejected ', links, ' listing links outside allowed source domains.') END, CASE WHEN warned THEN 'slow; token=secret' END, CASE WHEN blocked AND mode = 'exact' THEN told END) END, '') AS error_message FROM m""",
)
def l1(t):
    return intake.finished(_runs(t)[1], NOW).drop("finished_at")


@query(
    "l1_quarantine",
    "WITH l AS (SELECT source_id, external_id, arg_min(source_url, (id, source_url, quality_score, is_active)) AS url, arg_min(quality_score, (id, source_url, quality_score, is_active)) AS n FROM listings GROUP BY source_id, external_id), "
    "f AS (SELECT *, source_id % 2 = 0 AND source_id < 60 AND NOT regexp_matches(url, concat('^(https|HTTPS)://(www\\.)?site', source_id, '\\.example(:443)?/')) AS link FROM l WHERE source_id % 11 <> 5 AND NOT (source_id % 4 = 1 AND n % 3 = 0)) "
    "SELECT * FROM (SELECT source_id, external_id, CASE WHEN link THEN 'link' ELSE 'form' END AS fault, CASE WHEN link THEN concat('Unexpected listing URL for site', source_id, '.') WHEN n % 41 = 0 OR n % 43 = 0 THEN 'title is too short' WHEN n % 47 = 0 THEN 'company is too long' WHEN n % 53 = 0 THEN 'salary_currency is too short' WHEN n % 59 = 0 THEN 'work_mode is unknown: token=abc elsewhere' END AS reason FROM f) AS x WHERE reason IS NOT NULL",
)
def l1_quarantine(t):
    return intake.quarantine(_judged(t).where("fetched")).select("source_id", "external_id", "fault", "reason")


@query("l3_archived_after_runs", SQL_RUNS + """ SELECT l.source_id, l.external_id, CASE WHEN f.source_id IS NOT NULL THEN true WHEN l.is_active AND mode IS NOT NULL AND NOT blocked AND snap.source_id IS NULL THEN false ELSE l.is_active END AS is_active, CASE WHEN f.source_id IS NULL AND l.is_active AND mode IS NOT NULL AND NOT blocked AND snap.source_id IS NULL THEN CASE WHEN mode = 'exact' THEN 'source_closed' ELSE 'missing' END END AS archive_reason
FROM l LEFT JOIN m ON m.source_id = l.source_id LEFT JOIN f ON f.source_id = l.source_id AND f.external_id = l.external_id LEFT JOIN snap ON snap.source_id = l.source_id AND snap.external_id = l.external_id""")  # fmt: skip
def l3_archived(t):
    judged, state, held, snapshots = _runs(t)
    return intake.archived(held, state, judged, snapshots, NOW)


@query("k4_source_states", SQL_RUNS + """ SELECT source_id AS id, CASE WHEN broke THEN 'https://user:[REDACTED]@host failed' WHEN blocked AND mode = 'generic' THEN told ELSE nullif(concat_ws('; ', CASE WHEN links > 0 THEN concat('Rejected ', links, ' listing links outside allowed source domains.') END, CASE WHEN warned THEN 'slow; token=secret' END, CASE WHEN blocked AND mode = 'exact' THEN told END), '') END AS last_error, NOT (broke OR (blocked AND coalesce(mode = 'generic', false))) AS succeeded FROM m""")
def k4(t):
    sources = t.sources.select("id", F.lit(None).cast("timestamp").alias("last_run_at"), F.lit(None).cast("timestamp").alias("last_success_at"), "last_error")
    after = intake.source_states(sources, intake.finished(_runs(t)[1], NOW), NOW)
    return after.select("id", "last_error", F.col("last_success_at").isNotNull().alias("succeeded"))


@query("k6_sent_messages", "SELECT concat('default:', user_id, ':', event_id % 40) AS event_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS sent_at, arg_min(concat(event_type, ' of ', event_id), (ts, concat(event_type, ' of ', event_id))) AS text FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL")
def k6(t):
    """Events as messages of two sorts; a key's first one is sent."""
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir).where("event_type in ('click', 'purchase')")
    n = F.col("event_id").cast("string")
    messages = stream.select(F.concat(F.lit("default:"), F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 40).cast("string")).alias("event_key"), F.col("ts").alias("at"), F.concat("event_type", F.lit(" of "), n).alias("text"))
    folder = limits.run_folder(t.spark, "outbox")
    outbox.record(messages, f"{folder}/out", f"{folder}/state")
    return outbox.sent(t.spark, f"{folder}/out").select("event_key", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sent_at"), "text")

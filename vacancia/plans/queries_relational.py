"""Queries of predicates, joins, aggregates, windows, pages, set operations and lifecycle jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vacancia.functions.urls import trusted_listing
from vacancia.operators import dedup, ingest, lineage, listings, predicates, runs, stats
from vacancia.plans.bindings import HOSTS
from vacancia.plans.registry import query

SQL_TRUSTED = "(NOT (regexp_matches(name, '^site([0-9]|[1-5][0-9])$') AND CAST(substr(name, 5) AS INT) % 2 = 0 AND CAST(substr(name, 5) AS INT) < 60) OR regexp_matches(lower(source_url), concat('^https://(www[.])?', name, '[.]example(:443)?/')))"
SQL_ACTIVE = f"active_listings AS (SELECT l.*, s.name, s.enabled FROM listings l JOIN sources s ON l.source_id = s.id WHERE is_active AND enabled AND {SQL_TRUSTED})"
SQL_VISIBLE = "EXISTS (SELECT 1 FROM active_listings a WHERE a.opportunity_id = {0}) AND NOT EXISTS (SELECT 1 FROM user_states u WHERE u.opportunity_id = {0} AND disposition = 'hidden')"
SQL_RECENCY = "coalesce(source_updated_at, published_at, first_seen_at)"
SQL_LINKS = "links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY quality_score DESC, id ASC) AS rank FROM active_listings) AS r WHERE rank = 1)"
#: Finished runs in order, and the coverage issue of each successful one and of the one before it.
SQL_ISSUES = """fin AS (SELECT id, source_id, status, limit_reached AS lim, discovered_count AS n, started_at AS tm, row_number() OVER w AS rn, lag(status) OVER w AS before FROM runs WHERE finished_at IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY started_at, id)),
good AS (SELECT source_id, rn, list_reverse(list(lim) OVER w) AS ls, list_reverse(list(n) OVER w) AS ns FROM fin WHERE status = 'succeeded' WINDOW w AS (PARTITION BY source_id ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
shifted AS (SELECT source_id, rn, 0 AS k, ls, ns FROM good UNION ALL SELECT source_id, rn, 1, ls[2:], ns[2:] FROM good),
found AS (SELECT source_id, rn, k, CASE WHEN len(ls) >= 3 AND ls[1] AND ls[2] AND ls[3] THEN 'repeated_limit' WHEN len(ns) >= 5 AND base >= 10 AND ns[1] <= 0.5 * base AND ns[2] <= 0.5 * base THEN 'discovered_drop' END AS issue FROM (SELECT *, round_even(list_aggregate(ns[3:7], 'median'), 0) AS base FROM shifted) AS b),
e AS (SELECT fin.*, a.issue, b.issue AS previous FROM fin LEFT JOIN found a ON a.source_id = fin.source_id AND a.rn = fin.rn AND a.k = 0 LEFT JOIN found b ON b.source_id = fin.source_id AND b.rn = fin.rn AND b.k = 1)"""
SQL_ALERT = """CASE WHEN status = 'succeeded' AND fa THEN 'recovery' WHEN status IN ('failed', 'partial') THEN CASE WHEN fa AND coalesce(fr, 'failed') = status THEN NULL WHEN before = status THEN CASE status WHEN 'failed' THEN 'failure' ELSE 'partial' END END
WHEN status <> 'succeeded' THEN NULL WHEN ca THEN CASE WHEN issue IS NULL THEN 'coverage_recovery' END WHEN issue IS NULL OR (previous = issue AND cr IS DISTINCT FROM issue) THEN NULL ELSE 'coverage_issue' END"""
SINCE, CURSOR = datetime(1997, 1, 1), datetime(1996, 1, 1)


def visible_jobs(t):
    return listings.visible(t.opportunities, "id", t.listings, t.sources, HOSTS, t.user_states)


@query("p1_trusted_listing", f"SELECT l.id, {SQL_TRUSTED} AS trusted FROM listings l JOIN sources s ON l.source_id = s.id")
def p1(t):
    return listings.with_source(t.listings, t.sources).select("id", trusted_listing(F.col("name"), F.col("source_url"), HOSTS).alias("trusted"))


@query("p3_active_listings", f"WITH {SQL_ACTIVE} SELECT source_id, count(*) AS active FROM active_listings GROUP BY source_id")
def p3(t):
    rows = listings.with_source(t.listings, t.sources).where(predicates.active_listing(HOSTS))
    return rows.groupBy("source_id").agg(F.count("*").alias("active"))


@query("p4_text_search", "SELECT id FROM opportunities WHERE coalesce(title ILIKE '%urgent%', false) OR coalesce(company ILIKE '%urgent%', false) OR coalesce(description ILIKE '%urgent%', false)")
def p4(t):
    return t.opportunities.where(predicates.text_search("Urgent", "title", "company", "description")).select("id")


@query("p5_employment_type", "SELECT id FROM opportunities WHERE list_has_any(str_split(replace(replace(lower(employment_type), '-', '_'), ' ', ''), ','), ['full_time', 'fulltime', 'fulltime_permanent', 'full_time_permanent'])")
def p5(t):
    return t.opportunities.where(predicates.employment_type("Full Time")).select("id")


@query("p6_minimum_salary", "SELECT id FROM opportunities WHERE coalesce(salary_max, salary_min) >= 100000 AND upper(salary_currency) = 'USD' AND lower(salary_period) = 'month'")
def p6(t):
    return t.opportunities.where(predicates.minimum_salary(100_000, "usd")).select("id")


@query("p7_work_mode", "SELECT work_mode, count(*) AS n FROM opportunities WHERE work_mode = 'remote' GROUP BY work_mode")
def p7(t):
    return t.opportunities.where("work_mode = 'remote'").groupBy("work_mode").agg(F.count("*").alias("n"))


@query("p8_score_range", "SELECT opportunity_id, score FROM evaluations WHERE score BETWEEN 55 AND 90")
def p8(t):
    return t.evaluations.where(predicates.score_between(55, 90)).select("opportunity_id", "score")


@query("p9_explore_eligible", "SELECT id, score FROM opportunities JOIN evaluations ON id = opportunity_id WHERE (score >= 55 AND NOT score BETWEEN 35 AND 54) OR (score BETWEEN 35 AND 54 AND first_seen_at >= TIMESTAMP '1997-01-01')")
def p9(t):
    rows = t.opportunities.join(t.evaluations, F.col("id") == F.col("opportunity_id"))
    return rows.where(predicates.explore_eligible(55, SINCE)).select("id", "score")


@query("p10_notification_window", "SELECT id, first_seen_at >= CASE WHEN score BETWEEN 35 AND 54 THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '1996-01-01' END AS in_window FROM opportunities JOIN evaluations ON id = opportunity_id")
def p10(t):
    rows = t.opportunities.join(t.evaluations, F.col("id") == F.col("opportunity_id"))
    return rows.select("id", predicates.in_notification_window(CURSOR, SINCE).alias("in_window"))


SQL_ACTION = "CASE WHEN is_active AND coalesce(l.published_at, l.first_seen_at) <= c THEN 'expire' WHEN NOT is_active AND (archive_reason IS NULL OR archive_reason = 'missing') AND coalesce(l.published_at, l.first_seen_at) > c THEN 'restore' END"


@query(
    "l5_expire",
    f"SELECT kind, action, count(*) AS n FROM (SELECT kind, {SQL_ACTION} AS action FROM listings l JOIN (SELECT id AS oid, kind, CASE kind WHEN 'employment' THEN TIMESTAMP '1996-06-01' ELSE TIMESTAMP '1997-06-01' END AS c FROM opportunities) AS o ON l.opportunity_id = oid) AS x GROUP BY kind, action",
)
def l5(t):
    done = ingest.expire(t.listings, t.opportunities, {"employment": datetime(1996, 6, 1), "freelance_project": datetime(1997, 6, 1)})
    return done.groupBy("kind", "action").agg(F.count("*").alias("n"))


@query(
    "p12_retry_due",
    """SELECT d.id, next_attempt_at FROM deliveries d LEFT JOIN (SELECT opportunity_id AS h FROM user_states WHERE disposition = 'hidden') AS u ON d.opportunity_id = h
  WHERE status IN ('queued', 'failed') AND message_text IS NOT NULL AND (status = 'failed' OR h IS NULL) AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15')
  ORDER BY CASE status WHEN 'failed' THEN 0 ELSE 1 END, next_attempt_at ASC NULLS LAST, d.id LIMIT 50""",
)
def p12(t):
    hidden = t.user_states.where("disposition = 'hidden'").select(F.col("opportunity_id").alias("h"))
    rows = t.deliveries.join(hidden, F.col("opportunity_id") == F.col("h"), "left").withColumn("hidden", F.col("h").isNotNull())
    due = rows.where(predicates.retry_due(datetime(2024, 1, 15)))
    return due.orderBy(F.when(F.col("status") == "failed", 0).otherwise(1), F.asc_nulls_last("next_attempt_at"), "id").limit(50).select("id", "next_attempt_at")


@query("p13_jittered_interval")
def p13(t):
    last = runs.newest(t.runs, 1).join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return last.select("source_id", predicates.jittered_seconds(F.col("name"), F.col("started_at"), 900, 0.15).alias("seconds"))


@query("p17_coverage_warning", "SELECT id, CASE WHEN limit_reached THEN 'limit_reached' WHEN detail_failure_count > 0 THEN 'detail_failures' WHEN discovered_count = 0 THEN 'empty' END AS warning FROM runs")
def p17(t):
    return t.runs.select("id", runs.coverage_warning_or_null(t.runs).alias("warning"))


@query("j1_listing_source", "SELECT name, count(*) AS n, sum(quality_score) AS quality FROM listings l JOIN sources s ON l.source_id = s.id GROUP BY name")
def j1(t):
    return listings.with_source(t.listings, t.sources).groupBy("name").agg(F.count("*").alias("n"), F.sum("quality_score").alias("quality"))


@query("j2_evaluation_worklist", "SELECT DISTINCT o.id FROM opportunities o JOIN listings l ON l.opportunity_id = o.id JOIN sources s ON s.id = l.source_id WHERE is_active AND enabled")
def j2(t):
    active = listings.with_source(t.listings, t.sources).where("is_active and enabled").select("opportunity_id")
    return t.opportunities.join(active, F.col("id") == F.col("opportunity_id"), "left_semi").select("id")


@query("j3_opportunity_evaluation", "SELECT id, title, score FROM opportunities JOIN evaluations ON id = opportunity_id WHERE rules_version = 'v2'")
def j3(t):
    return t.opportunities.join(t.evaluations.where("rules_version = 'v2'"), F.col("id") == F.col("opportunity_id")).select("id", "title", "score")


JOBS_SQL = f"""WITH {SQL_ACTIVE}, {SQL_LINKS}, page AS (SELECT *, {SQL_RECENCY} AS recency FROM opportunities o WHERE {SQL_VISIBLE.format('o.id')} AND work_mode = 'remote' ORDER BY recency DESC, id DESC LIMIT 50 OFFSET 20)
SELECT page.id, title, recency, name AS source_name, source_url FROM page JOIN links ON links.opportunity_id = page.id"""


@query("jobs_page", JOBS_SQL)
def jobs_page(t):
    rows = visible_jobs(t).where("work_mode = 'remote'")
    return listings.page_with_links(rows, "recent", 50, 20, t.listings, t.sources, HOSTS).select("id", "title", "recency", "source_name", "source_url")


def _matches_sql(order: str, limit: int) -> str:
    return f"""WITH {SQL_ACTIVE}, {SQL_LINKS}, page AS (SELECT o.*, score, {SQL_RECENCY} AS recency FROM opportunities o JOIN evaluations e ON o.id = e.opportunity_id WHERE rules_version = 'v2' AND score BETWEEN 55 AND 100 AND {SQL_VISIBLE.format('o.id')} ORDER BY {order} LIMIT {limit})
SELECT page.id, score, company, recency, name AS source_name, source_url FROM page JOIN links ON links.opportunity_id = page.id"""


def _matches(t, sort, limit):
    rows = visible_jobs(t).join(t.evaluations.where("rules_version = 'v2'").where(predicates.score_between(55, 100)).select("opportunity_id", "score"), F.col("id") == F.col("opportunity_id")).drop("opportunity_id")
    return listings.page_with_links(rows, sort, limit, 0, t.listings, t.sources, HOSTS).select("id", "score", "company", "recency", "source_name", "source_url")


@query("o2_matches_by_score", _matches_sql("score DESC, recency DESC, o.id DESC", 200))
def o2(t):
    return _matches(t, "score", 200)


@query("o3_matches_by_newest", _matches_sql("recency DESC, score DESC, o.id DESC", 100))
def o3(t):
    return _matches(t, "newest", 100)


@query("o4_matches_by_company", _matches_sql("company IS NULL, lower(company) ASC, score DESC, o.id DESC", 100))
def o4(t):
    return _matches(t, "company", 100)


@query("w1_best_link", f"WITH {SQL_ACTIVE}, {SQL_LINKS} SELECT opportunity_id, id, quality_score FROM links")
def w1(t):
    return listings.best_link(t.listings, t.sources, HOSTS).select("opportunity_id", "id", "quality_score")


@query("o6_best_canonical", "SELECT opportunity_id, arg_max(l.id, (quality_score, -l.id)) AS id FROM listings l JOIN sources s ON s.id = source_id WHERE is_active AND enabled AND normalized GROUP BY opportunity_id")
def o6(t):
    return listings.best_canonical(t.listings, t.sources).select("opportunity_id", "id")


@query("best_for_matching", "SELECT opportunity_id, arg_max(l.id, (quality_score, -l.id)) AS id FROM listings l JOIN sources s ON s.id = source_id WHERE is_active AND enabled GROUP BY opportunity_id")
def best_for_matching(t):
    return listings.best_for_matching(t.listings, t.sources).select("opportunity_id", "id")


@query("l2_refresh_canonical", "SELECT o.id, CASE WHEN b.id IS NULL THEN 'stale' ELSE 'active' END AS status, b.id AS canonical_listing_id FROM opportunities o LEFT JOIN (SELECT opportunity_id, arg_max(l.id, (quality_score, -l.id)) AS id FROM listings l JOIN sources s ON s.id = source_id WHERE is_active AND enabled AND normalized GROUP BY opportunity_id) AS b ON b.opportunity_id = o.id")
def l2(t):
    return listings.refresh_canonical(t.opportunities, t.listings, t.sources).select("id", "status", "canonical_listing_id")


@query("l2_canonical_fields", "WITH b AS (SELECT opportunity_id, arg_max(l.id, (quality_score, -l.id)) AS lid FROM listings l JOIN sources s ON s.id = source_id WHERE is_active AND enabled AND normalized GROUP BY opportunity_id) SELECT o.id, CASE WHEN lid IS NULL THEN o.title ELSE concat('job ', lid) END AS title, CASE WHEN lid IS NULL THEN company END AS company, CASE WHEN lid IS NULL THEN salary_max ELSE CAST(lid % 1000 AS DECIMAL(14,2)) END AS salary_max, CASE WHEN lid IS NULL THEN 'old' ELSE sha256(concat('|job ', lid, '|kyiv|remote')) END AS canonical_key FROM opportunities o LEFT JOIN b ON b.opportunity_id = o.id")
def l2_fields(t):
    snapshot = F.struct(F.concat(F.lit("job "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("company"), F.lit("Kyiv").alias("location_text"), F.lit("remote").alias("work_mode"), (F.col("id") % 1000).cast("decimal(14,2)").alias("salary_max"))
    rows = t.opportunities.withColumn("canonical_key", F.lit("old"))
    return listings.refresh_canonical(rows, t.listings.withColumn("snapshot", snapshot), t.sources).select("id", "title", "company", "salary_max", "canonical_key")


@query("j5_sources_report", "SELECT s.id, name, enabled, r.id AS run_id, status, started_at, CASE WHEN limit_reached THEN 'limit_reached' WHEN detail_failure_count > 0 THEN 'detail_failures' WHEN discovered_count = 0 THEN 'empty' END AS warning, CASE WHEN coalesce(last_error, '') <> '' THEN 'Source reported an issue. Details are available internally.' END AS error FROM sources s LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1) AS r ON r.source_id = s.id")
def j5(t):
    return runs.sources_report(t.sources, t.runs)


@query("j6_expiration_scan", "SELECT count(*) AS n, count(u.disposition) AS with_state FROM listings l JOIN opportunities o ON o.id = l.opportunity_id LEFT JOIN user_states u ON u.opportunity_id = o.id")
def j6(t):
    rows = t.listings.join(t.opportunities.select(F.col("id").alias("opportunity_id"), "kind"), "opportunity_id").join(t.user_states, "opportunity_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("disposition").alias("with_state"))


@query("j7_run_source", "SELECT r.id, name, status FROM runs r JOIN sources s ON s.id = r.source_id")
def j7(t):
    return t.runs.join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id").select("id", "name", "status")


@query("j7_run_source_all", "SELECT r.id, name, status FROM runs r JOIN sources s ON s.id = r.source_id")
def j7_all(t):
    return t.runs.join(t.sources.select(F.col("id").alias("source_id"), "name"), "source_id").select("id", "name", "status")


@query("j8_with_active_listing", f"WITH {SQL_ACTIVE} SELECT id FROM opportunities o WHERE EXISTS (SELECT 1 FROM active_listings a WHERE a.opportunity_id = o.id)")
def j8(t):
    active = listings.with_source(t.listings, t.sources).where(predicates.active_listing(HOSTS)).select("opportunity_id")
    return t.opportunities.join(active, F.col("id") == F.col("opportunity_id"), "left_semi").select("id")


@query("j9_not_hidden", "SELECT id FROM opportunities o WHERE NOT EXISTS (SELECT 1 FROM user_states u WHERE u.opportunity_id = o.id AND disposition = 'hidden')")
def j9(t):
    hidden = t.user_states.where("disposition = 'hidden'").select("opportunity_id")
    return t.opportunities.join(hidden, F.col("id") == F.col("opportunity_id"), "left_anti").select("id")


@query("j10_listed_elsewhere", "SELECT id FROM opportunities o WHERE EXISTS (SELECT 1 FROM listings l WHERE l.opportunity_id = o.id AND source_id <> 3)")
def j10(t):
    return t.opportunities.join(t.listings.where("source_id <> 3").select("opportunity_id"), F.col("id") == F.col("opportunity_id"), "left_semi").select("id")


@query("j12_favorites", f"WITH {SQL_ACTIVE}, {SQL_LINKS} SELECT o.id, title, changed, name AS source_name, score FROM user_states u JOIN opportunities o ON o.id = u.opportunity_id LEFT JOIN links ON links.opportunity_id = o.id LEFT JOIN (SELECT * FROM evaluations WHERE rules_version = 'v2') AS e ON e.opportunity_id = o.id WHERE disposition = 'favorite'")
def j12(t):
    return stats.favorites(t.user_states, t.opportunities, t.listings, t.sources, t.evaluations, HOSTS, "v2").select("id", "title", "changed", "source_name", "score")


@query("j13_candidates", f"WITH {SQL_ACTIVE}, {SQL_LINKS} SELECT o.id, score, source_url FROM evaluations e JOIN opportunities o ON o.id = e.opportunity_id JOIN links ON links.opportunity_id = o.id WHERE rules_version = 'v2' AND ((score >= 55 AND NOT score BETWEEN 35 AND 54) OR (score BETWEEN 35 AND 54 AND o.first_seen_at >= TIMESTAMP '1997-01-01')) AND NOT EXISTS (SELECT 1 FROM user_states u WHERE u.opportunity_id = o.id AND disposition = 'hidden') ORDER BY score DESC, o.id DESC LIMIT 100")
def j13(t):
    return stats.candidates(t.evaluations.where("rules_version = 'v2'"), t.opportunities, t.listings, t.sources, t.user_states, HOSTS, 55, SINCE).limit(100).select("id", "score", "source_url")


@query("j14_pending_deliveries", "SELECT d.id, m.last_told FROM deliveries d LEFT JOIN (SELECT opportunity_id, max(created_at) AS last_told FROM deliveries WHERE status = 'sent' GROUP BY opportunity_id) AS m ON m.opportunity_id = d.opportunity_id WHERE d.status = 'pending'")
def j14(t):
    told = t.deliveries.where("status = 'sent'").groupBy("opportunity_id").agg(F.max("created_at").alias("last_told"))
    return t.deliveries.where("status = 'pending'").join(told, "opportunity_id", "left").select("id", "last_told")


@query("a1_count_jobs", f"WITH {SQL_ACTIVE} SELECT count(*) AS total FROM opportunities o WHERE {SQL_VISIBLE.format('o.id')}")
def a1(t):
    return visible_jobs(t).agg(F.count("*").alias("total"))


@query("a3_stats", "WITH act AS (SELECT DISTINCT opportunity_id FROM listings l JOIN sources s ON s.id = l.source_id WHERE is_active AND enabled), hid AS (SELECT opportunity_id FROM user_states WHERE disposition = 'hidden'), ev AS (SELECT e.* FROM evaluations e JOIN act USING (opportunity_id) ANTI JOIN hid USING (opportunity_id) WHERE rules_version = 'v2') SELECT (SELECT count(*) FROM opportunities) AS collected, (SELECT count(*) FROM opportunities JOIN act ON id = opportunity_id) AS active, (SELECT count(*) FROM ev) AS evaluated_active, (SELECT count(*) FROM ev WHERE score >= 55) AS matched, greatest(0, (SELECT count(*) FROM ev) - (SELECT count(*) FROM ev WHERE score >= 55)) AS filtered, (SELECT count(*) FROM user_states WHERE disposition = 'favorite') AS favorites, (SELECT count(*) FROM hid) AS hidden")
def a3(t):
    return stats.stats(t.opportunities, t.listings, t.sources, t.evaluations, t.user_states, "v2", 55)


@query("a4_run_ordinal", "SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS ordinal FROM runs")
def a4(t):
    return runs.run_ordinal(t.runs).select("id", F.col("ordinal").cast("long"))


@query("a5_duplicate_audit", "SELECT title_key, company_key, count(*) AS members, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, trim(regexp_replace(lower(title), '[-_/.,:;]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(company), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS company_key FROM opportunities WHERE company IS NOT NULL) AS x GROUP BY ALL HAVING count(*) > 1")
def a5(t):
    return dedup.audit(t.opportunities)


@query("a6_sources_of_opportunity", "SELECT opportunity_id, count(DISTINCT source_id) AS sources FROM listings GROUP BY opportunity_id")
def a6(t):
    return t.listings.groupBy("opportunity_id").agg(F.countDistinct("source_id").alias("sources"))


@query("a7_coverage_issues", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS age FROM runs WHERE status = 'succeeded'), g AS (SELECT source_id, list(limit_reached ORDER BY age) AS l, list(discovered_count ORDER BY age) AS c FROM r WHERE age <= 8 GROUP BY source_id),
b AS (SELECT *, round_even(list_median(c[3:7]), 0) AS b0, round_even(list_median(c[4:8]), 0) AS b1 FROM g)
SELECT source_id, CASE WHEN coalesce(l[1] AND l[2] AND l[3], false) THEN 'repeated_limit' WHEN len(c) >= 5 AND b0 >= 10 AND c[1] <= 0.5 * b0 AND c[2] <= 0.5 * b0 THEN 'discovered_drop' END AS issue, CASE WHEN coalesce(l[2] AND l[3] AND l[4], false) THEN 'repeated_limit' WHEN len(c) - 1 >= 5 AND b1 >= 10 AND c[2] <= 0.5 * b1 AND c[3] <= 0.5 * b1 THEN 'discovered_drop' END AS previous FROM b""")
def a7(t):
    return runs.coverage_issues(t.runs)


@query("a9_missing_ratio", "SELECT source_id, count(*) AS active, count(*) FILTER (gone) AS missing, count(*) FILTER (gone) > 0 AND (NOT EXISTS (SELECT 1 FROM listings m WHERE m.source_id = x.source_id AND m.normalized) OR count(*) FILTER (gone) * 5 > count(*) * 4) AS blocked FROM (SELECT source_id, NOT EXISTS (SELECT 1 FROM listings m WHERE m.source_id = l.source_id AND m.external_id = l.external_id AND m.normalized) AS gone FROM listings l WHERE is_active) AS x GROUP BY source_id")
def a9(t):
    seen = t.listings.where("normalized").select("source_id", "external_id")
    return ingest.reconcile(t.listings, seen)


@query("a10_outcomes", "SELECT source_id, count(*) AS discovered, count(*) FILTER (version <= 10) AS created, count(*) FILTER (version > 10 AND version <= 20) AS updated, count(*) FILTER (version > 20 AND version <= 45) AS unchanged, count(*) FILTER (version > 45 AND version <= 49) AS duplicate, count(*) FILTER (version > 49) AS failed, CASE WHEN count(*) FILTER (version > 49) = count(*) THEN 'failed' WHEN count(*) FILTER (version > 49) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM listings GROUP BY source_id")
def a10(t):
    outcome = F.when(F.col("version") <= 10, "created").when(F.col("version") <= 20, "updated").when(F.col("version") <= 45, "unchanged").when(F.col("version") <= 49, "duplicate").otherwise("failed")
    return runs.outcome_counts(t.listings.select("source_id", outcome.alias("outcome")))


@query("w2_latest_run", "SELECT source_id, id FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1")
def w2(t):
    return runs.newest(t.runs, 1).select("source_id", "id")


@query("w3_status_streak", "SELECT source_id, min(status) AS status FROM (SELECT * FROM runs WHERE finished_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) <= 2) AS x GROUP BY source_id HAVING count(*) = 2 AND min(status) = max(status)")
def w3(t):
    return runs.equal_last_two(t.runs)


@query("l13_health_events", f"WITH {SQL_ISSUES} SELECT id, status, issue, {SQL_ALERT} AS event FROM (SELECT s.id, e.status, e.before, g.issue, g.previous, s.id % 3 = 0 AS fa, 'failed' AS fr, s.id % 4 = 0 AS ca, CAST(NULL AS VARCHAR) AS cr FROM sources s JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY rn DESC) = 1) e ON e.source_id = s.id LEFT JOIN (SELECT * FROM e WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY rn DESC) = 1) g ON g.source_id = s.id) AS x")
def l13(t):
    state = t.sources.select("id", (F.col("id") % 3 == 0).alias("failure_alert_active"), F.lit("failed").alias("failure_alert_reason"), (F.col("id") % 4 == 0).alias("coverage_alert_active"), F.lit(None).cast("string").alias("pending_reason"))
    return runs.health_events(t.runs, state)


@query("l14_diagnostics", "SELECT source_id, CASE WHEN status = 'failed' THEN 'FAIL' WHEN status = 'partial' OR error_count > 0 THEN 'PARTIAL' WHEN discovered_count = 0 THEN 'EMPTY' ELSE 'OK' END AS state FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1")
def l14(t):
    return runs.diagnostics(t.runs)


@query("o9_latest_candidates", "SELECT id, score FROM (SELECT id, score, first_seen_at FROM opportunities JOIN evaluations ON id = opportunity_id ORDER BY first_seen_at DESC, id DESC LIMIT 40) AS x")
def o9(t):
    return t.opportunities.join(t.evaluations, F.col("id") == F.col("opportunity_id")).orderBy(F.desc("first_seen_at"), F.desc("id")).limit(40).select("id", "score")


@query("o10_historical_first", "SELECT id, first_seen_at >= TIMESTAMP '1996-01-01' AS in_window FROM opportunities JOIN evaluations ON id = opportunity_id ORDER BY in_window, score DESC, id DESC LIMIT 60")
def o10(t):
    rows = t.opportunities.join(t.evaluations, F.col("id") == F.col("opportunity_id")).withColumn("in_window", F.col("first_seen_at") >= F.lit(CURSOR))
    return rows.orderBy("in_window", F.desc("score"), F.desc("id")).limit(60).select("id", "in_window")


@query("u1_coverage_gap", "SELECT o.id FROM opportunities o WHERE kind = 'employment' EXCEPT SELECT opportunity_id FROM listings WHERE is_active")
def u1(t):
    return t.opportunities.where("kind = 'employment'").select("id").subtract(t.listings.where("is_active").select("opportunity_id"))


@query("u3_recheck_deltas", "SELECT source_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS gained, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS lost FROM (SELECT source_id, coalesce(list(DISTINCT external_id) FILTER (is_active), []) AS a, coalesce(list(DISTINCT external_id) FILTER (normalized), []) AS b FROM listings GROUP BY source_id) AS x")
def u3(t):
    ids = t.listings.groupBy("source_id", "external_id").agg(F.max(F.col("is_active")).alias("a"), F.max(F.col("normalized")).alias("b"))
    return ids.groupBy("source_id").agg(F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"))


@query("u4_missing_listings", "SELECT DISTINCT source_id, external_id FROM listings l WHERE is_active AND NOT EXISTS (SELECT 1 FROM listings m WHERE m.source_id = l.source_id AND m.external_id = l.external_id AND m.normalized)")
def u4(t):
    key = ["source_id", "external_id"]
    return t.listings.where("is_active").select(key).distinct().join(t.listings.where("normalized").select(key), key, "left_anti")


@query("u8_enabled_sources", "SELECT id, name IN ('site1', 'site2', 'site3') AS enabled FROM sources")
def u8(t):
    return ingest.enable_only(t.sources, ("site1", "site2", "site3")).select("id", "enabled")


@query("k1_upsert_sources", "SELECT name, CASE WHEN n.name2 IS NOT NULL THEN 'new' ELSE display_name END AS display_name FROM (SELECT coalesce(s.name, n.name2) AS name, s.display_name, n.name2 FROM sources s FULL JOIN (SELECT concat('site', id * 2) AS name2 FROM sources) AS n ON s.name = n.name2) AS n")
def k1(t):
    new = t.sources.select(F.concat(F.lit("site"), F.col("id") * 2).alias("name"), F.lit("new").alias("display_name"))
    return ingest.merge(t.sources.select("name", "display_name"), new, ["name"])


@query("k2_insert_absent", "SELECT count(*) AS n, count(DISTINCT (source_id, external_id)) AS keys FROM (SELECT source_id, external_id FROM listings WHERE is_active UNION ALL SELECT DISTINCT source_id, external_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM listings m WHERE is_active AND m.source_id = l.source_id AND m.external_id = l.external_id)) AS x")
def k2(t):
    rows = t.listings.select("source_id", "external_id", "is_active")
    merged = ingest.insert_absent(rows.where("is_active").drop("is_active"), rows.drop("is_active"), ["source_id", "external_id"])
    return merged.agg(F.count("*").alias("n"), F.countDistinct("source_id", "external_id").alias("keys"))


SQL_KEY = "(SELECT min(id) AS lid, source_id, external_id, arg_min(opportunity_id, (id, version, is_active)) AS opportunity_id, arg_min(version, (id, version, is_active)) AS version, arg_min(is_active, (id, version, is_active)) AS is_active FROM listings GROUP BY source_id, external_id)"


# Jobs published within twenty days of each other, with descriptions long enough to compare.
PROSE = "we look for people who build, test, run and mend services with care for their users"


@query(
    "k3_ingest_outcomes",
    f"""WITH l AS {SQL_KEY}, known AS (SELECT * FROM l WHERE is_active), o AS (SELECT *, concat(company, '|', title) AS k, id % 20 AS day FROM opportunities), inc AS (SELECT l.lid, l.source_id AS src, l.external_id AS ext, l.version, o.* FROM l JOIN o ON o.id = l.opportunity_id),
job AS (SELECT * FROM o WHERE kind = 'employment' AND company IS NOT NULL AND location_text IS NOT NULL AND work_mode <> 'unknown'), dup AS (SELECT src, ext, min(y.id) AS candidate FROM inc x JOIN job y ON x.k = y.k AND x.location_text = y.location_text AND x.work_mode = y.work_mode WHERE x.kind = 'employment' AND abs(x.day - y.day) <= 7
AND coalesce(lower(x.salary_currency) = lower(y.salary_currency), true) AND coalesce(lower(x.salary_period) = lower(y.salary_period), true) AND NOT coalesce(x.salary_min > y.salary_max, false) AND NOT coalesce(y.salary_min > x.salary_max, false)
AND EXISTS (SELECT 1 FROM known WHERE known.opportunity_id = y.id AND known.source_id <> x.src) GROUP BY src, ext)
SELECT inc.src AS source_id, inc.ext AS external_id, CASE WHEN known.lid IS NULL THEN CASE WHEN candidate IS NOT NULL THEN 'duplicate' ELSE 'created' END WHEN inc.version > 25 THEN 'updated' ELSE 'unchanged' END AS outcome, CASE WHEN known.lid IS NULL THEN candidate ELSE known.opportunity_id END AS opportunity_id
FROM inc LEFT JOIN known ON known.lid = inc.lid LEFT JOIN dup ON dup.src = inc.src AND dup.ext = inc.ext""",
)
def k3(t):
    # keys hardly repeat: rows are dealt out as they are and sorted once, and all that is asked of them by key reads their buckets
    dealt = t.listings.select("source_id", "external_id", F.struct("id", "version", "is_active", "opportunity_id").alias("l")).repartition("source_id", "external_id")
    first = dealt.groupBy("source_id", "external_id").agg(F.min("l").alias("l")).select("source_id", "external_id", "l.opportunity_id", "l.version", "l.is_active")
    first = lineage.bucketed(first, "source_id", "external_id")
    key = F.when(F.col("company").isNull(), F.concat(F.lit("|"), "title")).otherwise(F.concat("company", F.lit("|"), "title"))
    jobs = t.opportunities.withColumns({"canonical_key": key, "description": F.lit(PROSE), "published_at": F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 20).cast("int"))})
    version = F.col("version").cast("int").cast("string")
    incoming = first.join(jobs.withColumnRenamed("id", "opportunity_id"), "opportunity_id").drop("opportunity_id").withColumn("content_hash", F.when(F.col("version") > 25, F.lit("new")).otherwise(version))
    known = first.where("is_active").select("source_id", "external_id", version.alias("content_hash"), "opportunity_id", "is_active")
    return ingest.outcomes(incoming, known, jobs)


@query("l3_deactivate_missing", "WITH seen AS (SELECT DISTINCT source_id, external_id FROM listings WHERE normalized OR source_id % 2 = 0), act AS (SELECT l.source_id, count(*) AS a, count(*) FILTER (s.external_id IS NULL) AS m FROM listings l LEFT JOIN seen s ON s.source_id = l.source_id AND s.external_id = l.external_id WHERE is_active GROUP BY l.source_id), g AS (SELECT source_id, m > 0 AND (m * 5 > a * 4 OR NOT EXISTS (SELECT 1 FROM seen WHERE seen.source_id = act.source_id)) AS blocked FROM act) SELECT l.id, CASE WHEN is_active AND s.external_id IS NULL AND NOT coalesce(blocked, true) THEN false WHEN s.external_id IS NOT NULL THEN true ELSE is_active END AS is_active FROM listings l LEFT JOIN g ON g.source_id = l.source_id LEFT JOIN seen s ON s.source_id = l.source_id AND s.external_id = l.external_id")
def l3(t):
    seen = t.listings.where("normalized or source_id % 2 = 0").select("source_id", "external_id").distinct()
    return ingest.deactivate_missing(t.listings, seen, datetime(2024, 1, 1)).select("id", "is_active")


@query("l7_merge_states", "SELECT opportunity_id // 3 * 3 AS opportunity_id, CASE max(CASE disposition WHEN 'favorite' THEN 2 WHEN 'hidden' THEN 1 ELSE 0 END) WHEN 2 THEN 'favorite' WHEN 1 THEN 'hidden' ELSE 'new' END AS disposition FROM user_states GROUP BY 1")
def l7(t):
    merges = t.opportunities.where("id % 3 <> 0").select("id", (F.col("id") - F.col("id") % 3).alias("into"))
    return dedup.merge_states(t.user_states, merges)


@query("l8_merge_deliveries", "SELECT opportunity_id, arg_max(id, (r, told, -id)) AS id, arg_max(status, (r, told, -id)) AS status FROM (SELECT id, opportunity_id // 3 * 3 AS opportunity_id, status, message_text IS NOT NULL AS told, CASE status WHEN 'sent' THEN 5 WHEN 'pending' THEN 4 WHEN 'failed' THEN 3 WHEN 'queued' THEN 2 ELSE 1 END AS r FROM deliveries) AS x GROUP BY opportunity_id")
def l8(t):
    merges = t.opportunities.where("id % 3 <> 0").select("id", (F.col("id") - F.col("id") % 3).alias("into"))
    return dedup.merge_deliveries(t.deliveries, merges)


@query("l9_dispositions", "SELECT coalesce(s.opportunity_id, c.id) AS opportunity_id, coalesce(c.d, s.disposition) AS disposition FROM user_states s FULL JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE 'hidden' END AS d FROM opportunities WHERE id % 2 = 0) AS c ON c.id = s.opportunity_id WHERE coalesce(c.d, s.disposition) <> 'new'")
def l9(t):
    changes = t.opportunities.where("id % 2 = 0").select(F.col("id").alias("opportunity_id"), F.when(F.col("id") % 4 == 0, "new").otherwise("hidden").alias("disposition"))
    return ingest.set_disposition(t.user_states, changes)


def _text_listings(t):
    """Documents as listings of jobs, so that descriptions have words to share."""
    docs = t.raw("documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("engineer "), "lang").alias("title"), F.lit("Acme LLC").alias("company"), F.lit("Kyiv").alias("location_text"), F.lit("remote").alias("work_mode"),
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.col("doc_id").cast("int") % 40)).alias("published_at"), F.col("text").alias("description"),
        F.lit(None).cast("string").alias("salary_currency"), F.lit(None).cast("string").alias("salary_period"), F.lit(None).cast("decimal(14,2)").alias("salary_min"), F.lit(None).cast("decimal(14,2)").alias("salary_max"),
        (F.col("doc_id") % 4).alias("source_id"),
    )


SQL_PAIRS = f"""d AS (SELECT doc_id AS id, lang, doc_id % 40 AS day, {{norm}} AS n FROM documents), k AS (SELECT *, length(n) AS len, list_distinct(regexp_extract_all(n, '[\\p{{{{L}}}}\\p{{{{N}}}}_]+')) AS t FROM d)
SELECT x.id AS left_id, y.id AS right_id FROM k x JOIN k y ON x.lang = y.lang AND x.id < y.id AND abs(x.day - y.day) <= 7 WHERE least(x.len, y.len) >= 40 AND greatest(x.len, y.len) <= 1.5 * least(x.len, y.len) AND least(len(x.t), len(y.t)) >= 8
AND len(list_intersect(x.t, y.t)) * 10 >= 8 * least(len(x.t), len(y.t))"""


@query("d1_duplicate_pairs", "WITH " + SQL_PAIRS.format(norm="replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"))
def d1(t):
    return dedup.duplicate_pairs(_text_listings(t))


@query("l6_greedy_merges")
def l6(t):
    rows = _text_listings(t)
    return dedup.greedy_merges(rows, rows.select(F.col("id").alias("opportunity_id"), "source_id"))

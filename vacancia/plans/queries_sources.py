"""Queries of source readers, set-based feed logic and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.plans.registry import query
from vacancia.sources import exports, feeds, pages
from vacancia.streaming import limits


@query("s3_union_feeds", "WITH f AS (SELECT p_name AS external_id, p_size AS feed_order, p_partkey AS position FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) = 1) SELECT external_id, feed_order, position, external_id LIKE 'red%' AS is_cached FROM f ORDER BY is_cached, feed_order, position LIMIT 40")
def s3(t):
    rows = t.raw("part").select(F.col("p_name").alias("external_id"), F.col("p_size").alias("feed_order"), F.col("p_partkey").alias("position"))
    return feeds.union_feeds(rows, rows.where("external_id like 'red%'"), 40)[0].select("external_id", "feed_order", "position", "is_cached")


@query("s5_overlay", "SELECT p_partkey AS external_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type END AS description FROM part")
def s5(t):
    part = t.raw("part")
    now = part.select(F.col("p_partkey").alias("external_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" ").alias("description"))
    old = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("external_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("description"))
    return feeds.overlay(now, old, ["brand"]).select("external_id", "brand", "description")


@query("s6_detail_due", "SELECT external_id, priority FROM (SELECT l_orderkey AS external_id, l_partkey, CASE WHEN checked IS NULL THEN 0 WHEN l_shipdate + INTERVAL '3' DAY > checked THEN 1 WHEN checked < TIMESTAMP '1996-01-01' - INTERVAL '24' HOUR THEN 2 END AS priority, checked FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate + to_days(CAST(l_linenumber AS INT)) END AS checked FROM lineitem) AS x) AS y WHERE priority IS NOT NULL ORDER BY priority, checked NULLS FIRST, external_id LIMIT 30")
def s6(t):
    rows = t.raw("lineitem")
    checked = F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber").cast("int")))
    rows = rows.select(F.col("l_orderkey").alias("external_id"), checked.alias("checked_at"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("source_updated_at"))
    return feeds.detail_due(rows, F.lit("1996-01-01").cast("timestamp_ntz"), 24, 30).select("external_id", "priority")


@query("s6_detail_due_all", "SELECT external_id, priority FROM (SELECT l_orderkey AS external_id, CASE WHEN checked IS NULL THEN 0 WHEN l_shipdate + INTERVAL '3' DAY > checked THEN 1 WHEN checked < TIMESTAMP '1996-01-01' - INTERVAL '24' HOUR THEN 2 END AS priority, checked FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate + to_days(CAST(l_linenumber AS INT)) END AS checked FROM lineitem) AS x) AS y WHERE priority IS NOT NULL ORDER BY priority, checked NULLS FIRST, external_id LIMIT 30")
def s6_all(t):
    """Of all rows. Rows that tie in the whole order give the same output, so it is settled though keys repeat."""
    checked = F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber").cast("int")))
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("external_id"), checked.alias("checked_at"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("source_updated_at"))
    return feeds.detail_due(rows, F.lit("1996-01-01").cast("timestamp_ntz"), 24, 30).select("external_id", "priority")


@query("s7_json_ld")
def s7(t):
    script = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Thing","JobPosting"],"title":"Job '), F.col("page_id").cast("string"), F.lit('","identifier":{"value":"'), F.col("page_id").cast("string"), F.lit('"},"jobLocationType":"TELECOMMUTE","baseSalary":{"currency":"usd","value":{"minValue":10,"unitText":"HOUR"}}},{"@type":"Other"}]}</script><script type="application/ld+json">{broken</script>'))
    rows = t.raw("pages").select("page_id", F.concat("html", script).alias("html"))
    return pages.posting_fields(pages.json_ld(rows)).select("page_id", "external_id", "title", "work_mode", "salary_min", "salary_currency", "salary_period")


@query("s8_html_cards")
def s8(t):
    return pages.html_cards(t.raw("pages"), "page_id", "ad", {"label": "ad"})


@query("s9_markdown_cards", "SELECT p_partkey, 0 AS position, p_name AS title, concat('https://x.example/', p_partkey) AS url, 2 AS lines FROM part UNION ALL SELECT p_partkey, 1, p_type, 'https://x.example/o', 1 FROM part")
def s9(t):
    text = F.concat(F.lit("# Jobs\n## ["), "p_name", F.lit("](https://x.example/"), F.col("p_partkey").cast("string"), F.lit(")\n\n1 000 грн\nKyiv\n## ["), "p_type", F.lit("](https://x.example/o)\nremote\n"))
    cards = pages.markdown_cards(t.raw("part").select("p_partkey", text.alias("markdown")))
    return cards.select("p_partkey", "position", "title", "url", F.size("lines").alias("lines"))


@query("s11_challenge", "SELECT page_id, page_id % 3 = 0 AS challenge FROM pages")
def s11(t):
    text = F.when(F.col("page_id") % 3 == 0, "<p>Checking your browser</p>").otherwise("<div class=g-recaptcha>")
    return t.raw("pages").select("page_id", pages.challenge(text, F.col("page_id") >= 0).alias("challenge"))


@query("s12_with_details", "SELECT p_partkey AS external_id, CASE WHEN p_partkey % 3 = 0 THEN 'complete' WHEN p_partkey % 2 = 0 THEN 'cached' ELSE 'summary' END AS detail_status, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS description FROM part")
def s12(t):
    part = t.raw("part").withColumn("external_id", F.col("p_partkey"))
    fetched = part.where("p_partkey % 3 = 0").select("external_id", F.col("p_type").alias("description"))
    cached = part.where("p_partkey % 2 = 0").select("external_id", F.col("p_brand").alias("description"), F.lit("complete").alias("detail_status"))
    return feeds.with_details(part.select("external_id", F.col("p_name").alias("summary")), fetched, cached).select("external_id", "detail_status", "description")


@query("s14_api_details", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 2 = 0 END AS remote FROM part")
def s14(t):
    answer = F.to_json(F.struct((F.col("p_partkey") + F.when(F.col("p_partkey") % 8 == 4, 1).otherwise(0)).cast("string").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 8 != 0).alias("isActive"), F.array(F.struct(F.array(F.struct((F.col("p_partkey") % 2).cast("int").alias("id"))).alias("groups"))).alias("clusters")))
    rows = t.raw("part").select("p_partkey", F.col("p_partkey").cast("string").alias("external_id"), answer.alias("json"))
    return pages.api_details(rows, "json", 0).select("p_partkey", "name", "remote")


@query("s16_export_candidates", "SELECT p_partkey FROM part WHERE (p_size % 5 = 2 OR p_name LIKE '%widget%') AND (p_size = 11 OR p_type = 'ECONOMY')")
def s16(t):
    rows = t.raw("part").select("p_partkey", F.col("p_name").alias("Name"), F.lit("").alias("DescriptionShort"), F.when(F.col("p_type") == "ECONOMY", "Remote work").alias("WorkType"), F.col("p_size").alias("CityId"), F.array(F.col("p_size") % 5).alias("RubricId"))
    return pages.export_candidates(rows, (2,), ("widget",), 11).select("p_partkey")


@query("s15_export", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, concat(chr(8222), 'Заявка ', o_orderkey, chr(10), '\"[{') AS description, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS salary, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7 + 1)::BIGINT ELSE 0 END AS rubrics, o_totalprice AS price FROM orders")
def s15(t):
    """Orders as exports that are written and read back."""
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        k.alias("Id"), F.col("o_orderpriority").alias("Name"), F.concat(F.lit("„Заявка "), k.cast("string"), F.lit('\n"[{')).alias("Description"), F.when(k % 5 != 0, F.col("o_custkey")).otherwise(None).alias("Salary"),
        F.when(k % 2 == 0, F.sequence(F.lit(1), (k % 7 + 1).cast("int"))).alias("RubricId"), F.col("o_totalprice").cast("double").alias("price"), F.struct(k.alias("more")).alias("Other"),
    )
    folder = limits.run_folder(t.spark, "export")
    exports.write(rows, folder)
    read = exports.read(t.spark, folder, "Id string, Name string, Description string, Salary long, RubricId array<int>, price double")
    return read.select(F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("Description").alias("description"), F.col("Salary").alias("salary"), F.coalesce(F.size("RubricId"), F.lit(0)).cast("long").alias("rubrics"), "price")


@query("s17_search_batch", "SELECT p_partkey AS position FROM part WHERE p_partkey < 3 OR (((p_partkey - 3 - 7 * 5) % ((SELECT count(*) FROM part) - 3)) + (SELECT count(*) FROM part) - 3) % ((SELECT count(*) FROM part) - 3) < 5")
def s17(t):
    rows = t.raw("part").select(F.col("p_partkey").alias("position"))
    return feeds.search_batch(rows, 8, 7, 3, rows.count())


@query("s21_exchange_rates", "SELECT n_name AS code, CAST(n_nationkey + 0.5 AS DECIMAL(20,8))::DOUBLE AS rate, DATE '2026-04-05' AS effective_date FROM (SELECT upper(trim(n_name)) AS n_name, n_nationkey FROM nation) AS n WHERE n_nationkey % 5 <> 0")
def s21(t):
    item = F.struct(F.col("n_name").alias("cc"), F.when(F.col("n_nationkey") % 5 == 0, "NaN").otherwise((F.col("n_nationkey") + 0.5).cast("string")).alias("rate"), F.lit("05.04.2026").alias("exchangedate"))
    rows = t.raw("nation").select(F.to_json(F.array(item)).alias("json"))
    return pages.exchange_rates(rows).select("code", F.col("rate").cast("double"), "effective_date")


@query("r1_ignored_category", "SELECT p_brand AS feed, NOT bool_or(p_type = 'ECONOMY') AS ignored FROM part GROUP BY p_brand")
def r1(t):
    rows = t.raw("part").select(F.col("p_brand").alias("feed"), F.array(F.concat(F.lit(" "), F.initcap("p_type"))).alias("category"))
    return feeds.ignores_category(rows, "Economy")


@query("u2_split_gap", "SELECT DISTINCT p_brand AS parent, p_name AS external_id FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_name = part.p_name AND q.p_size % 2 = 0)")
def u2(t):
    part = t.raw("part")
    own = part.select(F.col("p_brand").alias("parent"), F.lit(None).cast("int").alias("child"), F.col("p_name").alias("external_id"))
    return feeds.split_gap(own.union(part.where("p_size % 2 = 0").select("p_brand", "p_size", "p_name")))


@query("f9_html_text")
def f9(t):
    return t.raw("pages").select("page_id", F.length(pages.text_of_html(F.col("html"))).alias("n_chars"))


def _requests(rows):
    return rows.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


@query("t1_request_budget")
def t1(t):
    return limits.batch_request_budget(_requests(t.raw("events")), 100, 3600 * 24.0)


@query("t1_request_budget_stream")
def t1_stream(t):
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return limits.run_available(limits.request_budget(_requests(stream), 100, 3600 * 24.0), t.spark, limits.run_folder(t.spark, "budget"))


@query("t4_late_rows", "SELECT count(*) FILTER (first_seen_at >= TIMESTAMP '1996-01-01') AS in_time, count(*) FILTER (first_seen_at < TIMESTAMP '1996-01-01') AS late FROM opportunities")
def t4(t):
    from datetime import datetime

    now, late = limits.split_late(t.opportunities, datetime(1996, 1, 1))
    return now.agg(F.count("*").alias("in_time")).crossJoin(late.agg(F.count("*").alias("late")))  # one row each


@query(
    "l10_next_deliveries",
    """WITH d AS (SELECT opportunity_id, status, arg_max(id, id) AS id FROM deliveries GROUP BY opportunity_id, status QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY max(id) DESC) = 1), c AS (SELECT opportunity_id, concat('k', score) AS k, concat('t', score) AS m FROM evaluations WHERE score > 50)
SELECT coalesce(d.opportunity_id, c.opportunity_id) AS opportunity_id, coalesce(status, 'queued') AS status, CASE WHEN d.opportunity_id IS NULL OR (status IN ('queued', 'failed') AND k IS NOT NULL) THEN k ELSE 'old' END AS event_key, CASE WHEN d.opportunity_id IS NULL OR (status = 'queued' AND k IS NOT NULL) THEN m ELSE 'old' END AS message_text FROM d FULL JOIN c ON d.opportunity_id = c.opportunity_id""",
)
def l10(t):
    last = t.deliveries.groupBy("opportunity_id").agg(F.max_by("status", "id").alias("status")).withColumns({"event_key": F.lit("old"), "message_text": F.lit("old")})
    new = t.evaluations.where("score > 50").select("opportunity_id", F.concat(F.lit("k"), "score").alias("event_key"), F.concat(F.lit("t"), "score").alias("message_text"))
    from datetime import datetime

    return limits.next_deliveries(last, new, datetime(2024, 1, 1), paused=False)

"""Queries of backfills, registries, messages and nested values over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vacancia.functions import markup, messages
from vacancia.operators import upkeep
from vacancia.plans.registry import query

SQL_TEXT = "replace(lower(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("k5_upsert_evaluations", "SELECT opportunity_id, rules_version, CASE WHEN opportunity_id % 3 = 0 THEN 1 ELSE score END AS score FROM evaluations")
def k5(t):
    new = t.evaluations.where("opportunity_id % 3 = 0").withColumn("score", F.lit(1))
    return upkeep.upsert_evaluations(t.evaluations, new).select("opportunity_id", "rules_version", "score")


def _registry(t):
    return t.raw("events").select(F.col("event_id").alias("telegram_message_id"), F.col("user_id").alias("delivery_id"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).cast("timestamp").alias("deleted_at"))


@query("k7_soft_delete", "SELECT event_id AS telegram_message_id, event_id % 4 = 0 OR event_id % 6 = 0 AS deleted FROM events")
def k7(t):
    ids = t.raw("events").where("event_id % 6 = 0").select(F.col("event_id").alias("telegram_message_id"))
    return upkeep.mark_deleted(_registry(t), ids, datetime(2024, 2, 1)).select("telegram_message_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("r14_active_messages", "SELECT event_id AS telegram_message_id FROM events WHERE event_id % 4 <> 0")
def r14(t):
    return upkeep.active_messages(_registry(t))


@query("k10_verify_snapshot", "SELECT 'listings' AS name, (SELECT count(*) FROM listings) AS before, (SELECT count(*) FROM listings WHERE is_active) AS after, (SELECT count(*) FROM listings) = (SELECT count(*) FROM listings WHERE is_active) AS equal UNION ALL SELECT 'sources', count(*), count(*), true FROM sources")
def k10(t):
    return upkeep.verify_snapshot({"listings": t.listings, "sources": t.sources}, {"listings": t.listings.where("is_active"), "sources": t.sources})


@query("j16_repoint_messages", "SELECT event_id AS telegram_message_id, user_id - user_id % 3 AS delivery_id FROM events")
def j16(t):
    merges = t.raw("events").select(F.col("user_id").alias("id")).distinct().where("id % 3 <> 0").select("id", (F.col("id") - F.col("id") % 3).alias("into"))
    return upkeep.repoint_messages(_registry(t), merges).select("telegram_message_id", "delivery_id")


@query("b1_backfill_quality", f"SELECT opportunity_id, max(CAST(least(length({SQL_TEXT}), 20000) + CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN 2000 ELSE 0 END + 100 * ((company IS NOT NULL)::INT + (location_text IS NOT NULL)::INT + (salary_currency IS NOT NULL)::INT + (salary_period IS NOT NULL)::INT) AS INT)) AS quality_score, count(*) AS n FROM listings l JOIN opportunities o ON o.id = l.opportunity_id GROUP BY opportunity_id")
def b1(t):
    return upkeep.backfill_quality(t.listings, t.opportunities).groupBy("opportunity_id").agg(F.max("quality_score").alias("quality_score"), F.count("*").alias("n"))


@query("b2_backfill_skills", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string([p_brand, p_type], '|') ELSE '' END AS skills FROM part")
def b2(t):
    reason = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Skills: "), "p_brand", F.lit(", "), "p_type", F.lit("."))).otherwise(F.lit("Remote."))
    rows = t.raw("part").select("p_partkey", F.array(F.lit("Other."), reason).alias("reasons"))
    return upkeep.backfill_skills(rows, "Skills: ").select("p_partkey", F.array_join("matched_skills", "|").alias("skills"))


@query(
    "b3_backfill_dates",
    """WITH l2 AS (SELECT l.id, l.opportunity_id, l.quality_score, CASE WHEN name = 'site3' THEN l.published_at END AS u, CASE WHEN name <> 'site3' THEN l.published_at END AS p FROM listings l JOIN sources s ON s.id = l.source_id WHERE is_active AND enabled AND normalized),
b AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY quality_score DESC, id) = 1)
SELECT o.id, CASE WHEN b.id IS NULL THEN o.published_at ELSE p END AS published_at, CASE WHEN b.id IS NULL THEN o.source_updated_at ELSE u END AS source_updated_at FROM opportunities o LEFT JOIN b ON b.opportunity_id = o.id""",
)
def b3(t):
    return upkeep.backfill_dates(t.listings, t.sources, t.opportunities, "site3").select("id", "published_at", "source_updated_at")


@query("b4_backfill_archive", "SELECT coalesce(CASE WHEN NOT is_active THEN coalesce(archive_reason, 'missing') END, 'none') AS reason, count(*) AS n FROM listings GROUP BY 1")
def b4(t):
    return upkeep.backfill_archive(t.listings).groupBy(F.coalesce("archive_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("r11_snapshot_ids", "SELECT DISTINCT external_id FROM listings WHERE source_id = 1")
def r11(t):
    return upkeep.snapshot_ids(t.listings.where("source_id = 1").select(F.concat(F.lit("  "), "external_id").alias("external_id")))


@query("r13_disposition", "SELECT id, coalesce(disposition, 'new') AS disposition FROM opportunities LEFT JOIN user_states ON id = opportunity_id")
def r13(t):
    return upkeep.disposition_of(t.opportunities, t.user_states)


@query("o12_rechecks", "WITH f AS (SELECT p_brand AS parent, p_name AS child, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT parent, child FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY child ORDER BY turn, parent) = 1) AS x ORDER BY turn, parent LIMIT 12")
def o12(t):
    rows = t.raw("part").select(F.col("p_brand").alias("parent"), F.col("p_name").alias("child"), F.col("p_partkey").alias("position"))
    return upkeep.rechecks(rows, 12)


@query("r19_explanations", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Rejected: region (latin america).' WHEN 1 THEN 'Rejected: unpaid or volunteer work.' ELSE 'other' END AS explanation FROM part")
def r19(t):
    code = F.element_at(F.array(F.lit("region_latin_america"), F.lit("unpaid"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.raw("part").select("p_partkey", F.get(messages.explain_all(F.array(code)), F.lit(0)).alias("explanation"))


@query("f39_match_message", "SELECT id, concat('<b>', title, '</b>', CASE WHEN score BETWEEN 35 AND 54 THEN ' (Explore)' ELSE '' END, CASE WHEN company IS NULL THEN '' ELSE concat(chr(10), company) END, chr(10), 'Score: ', score, chr(10), '+ a &lt; b', chr(10), '- c', chr(10), 'https://x.example/?a=1&amp;b=2') AS message FROM opportunities JOIN evaluations ON id = opportunity_id")
def f39(t):
    rows = t.opportunities.join(t.evaluations, F.col("id") == F.col("opportunity_id"))
    text = messages.match_message(F.col("title"), F.col("company"), F.col("score"), F.array(F.lit("a < b")), F.array(F.lit("c")), F.lit("https://x.example/?a=1&b=2"))
    return rows.select("id", text.alias("message"))


@query("r18_masked_errors", "SELECT id, CASE WHEN coalesce(last_error, '') <> '' THEN 'Source reported an issue. Details are available internally.' END AS error FROM sources")
def r18(t):
    return t.sources.select("id", messages.masked(F.col("last_error")).alias("error"))


@query("r21_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def r21(t):
    rows = t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.where("k is not null")


@query("f30_string_values", "SELECT p_partkey, concat(p_name, '|', p_brand, '|', p_type) AS names FROM part")
def f30(t):
    first, second = F.struct(F.col("p_name").alias("name"), F.lit(" ").alias("label"), F.col("p_brand").alias("slug")), F.struct(F.col("p_type").alias("title"))
    nested = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    return t.raw("part").select("p_partkey", F.array_join(markup.string_values(nested), "|").alias("names"))


@query("f40_application_urls", "SELECT p_partkey, concat('https://x.example/', p_partkey) AS urls FROM part")
def f40(t):
    nested = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("ApplyUrl"), F.lit("https://y.example/").alias("logo"))).alias("offers")))
    return t.raw("part").select("p_partkey", F.array_join(markup.application_urls(nested), "|").alias("urls"))


@query(
    "r16_redact_json",
    """SELECT event_id, concat('{"api_key": "[REDACTED]", "n": {"Password": "[REDACTED]", "v": ', event_id, ', "note": "', CASE event_id % 5 WHEN 0 THEN concat('https://u:[REDACTED]@host/', event_id) WHEN 1 THEN 'https://h/?a=1&token=[REDACTED]&b=2' WHEN 2 THEN 'Authorization: [REDACTED] [REDACTED] end'
WHEN 3 THEN concat('[REDACTED] of ', event_type) ELSE event_type END, '"}, "list": ["plain", "password=[REDACTED], kept"]}') AS props FROM events""",
)
def r16(t):
    """Secrets under keys, and within texts: URLs, query parameters, headers and bot tokens."""
    n = F.col("event_id").cast("string")
    note = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("https://u:pw"), n, F.lit("@host/"), n)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("https://h/?a=1&token=t"), n, F.lit("&b=2")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("Authorization: Bearer x"), n, F.lit(" end"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("1234567:abcdefghijklmnopqrstu"), n, F.lit(" of "), "event_type")).otherwise(F.col("event_type"))
    )
    nested = F.to_json(F.struct(F.lit("x").alias("api_key"), F.struct(F.lit("y").alias("Password"), F.col("event_id").alias("v"), note.alias("note")).alias("n"), F.array(F.lit("plain"), F.concat(F.lit("password=p"), n, F.lit(", kept"))).alias("list")))
    return t.raw("events").select("event_id", markup.redact_json(nested).alias("props"))


@query("f10_description_text")
def f10(t):
    return t.raw("pages").select("page_id", F.length(markup.description_text(F.col("html"))).alias("n_chars"))


@query("f11_decode_html", "SELECT p_partkey, concat(p_name, ' & <b> ', p_type) AS decoded FROM part")
def f11(t):
    return t.raw("part").select("p_partkey", markup.decode_html(F.concat("p_name", F.lit(" &amp;\n &lt;b&gt; "), "p_type")).alias("decoded"))


@query("w4_previous_issue", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS age FROM runs WHERE status = 'succeeded') SELECT source_id, bool_and(limit_reached) FILTER (age <= 3) AND count(*) FILTER (age <= 3) = 3 AS repeated_limit FROM r GROUP BY source_id""")
def w4(t):
    from vacancia.operators.runs import newest

    top = newest(t.runs.where("status = 'succeeded'"), 3).groupBy("source_id").agg(F.min("limit_reached").alias("all_limited"), F.count("*").alias("n"))
    return top.select("source_id", (F.col("all_limited") & (F.col("n") == 3)).alias("repeated_limit"))

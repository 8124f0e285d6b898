"""Queries of the scoring rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.functions.profile import EXAMPLE
from vacancia.operators import scoring
from vacancia.plans.queries_functions import RATES
from vacancia.plans.registry import query

PLACE = "array<struct<country:string,region:string,city:string>>"


def document_candidates(t):
    """Documents as candidates; tags and levels follow from ids, so that all rules are met."""
    none = lambda kind: F.lit(None).cast(kind)
    k = F.col("doc_id")
    return t.raw("documents").select(
        k.alias("id"), F.when(k % 7 == 0, "freelance_project").otherwise("employment").alias("kind"),
        F.element_at(F.array(*map(F.lit, ("Junior Python developer", "Backend engineer", "Senior web developer", "Middle full-stack developer", "QA engineer"))), (k % 5 + 1).cast("int")).alias("title"),
        F.col("source").alias("company"), F.concat(F.col("text"), F.when(k % 3 == 0, "\nRequirements: Python, Django. Nice to have: Java, Docker.").otherwise("\nWe are a PHP company. 2 years of experience required.")).alias("description"),
        F.lit("Prague").alias("location_text"), F.when(k % 4 == 0, "onsite").otherwise("remote").alias("work_mode"), F.when(k % 2 == 0, "full_time").alias("employment_type"), F.lit("hourly").alias("contract_type"),
        (k % 50).cast("decimal(14,2)").alias("salary_min"), (k % 50 * 2).cast("decimal(14,2)").alias("salary_max"), F.lit("USD").alias("salary_currency"), F.lit("hour").alias("salary_period"),
        F.array(F.lit("react")).alias("tags"), F.array(F.lit("Entry-Level")).alias("levels"), (k % 30).cast("int").alias("months_required"), none(PLACE).alias("requires_residence"), none(PLACE).alias("offices"),
        F.array(F.concat(F.lit("https://x.example/"), F.when(k % 11 == 0, "pricing").otherwise("apply"))).alias("application_urls"), F.lit(1).cast("decimal(14,6)").alias("usd_rate"), (k % 300).cast("int").alias("bid_count"),
        (k % 2 == 0).alias("payment_verified"), (k % 6).cast("double").alias("rating"), (k % 9).cast("int").alias("reviews"), F.lit("en").alias("language"), (k % 5 == 0).alias("truncated"),
    )


@query("m_evaluation")
def m_evaluation(t):
    # the evidence is the work: a table of few row groups is dealt out to all cores before it
    return scoring.score(document_candidates(t).repartition(t.spark.sparkContext.defaultParallelism), EXAMPLE, RATES).select("id", "score", "rejection", F.size("matched_skills").alias("n_skills"))


SQL_PERIOD = "CASE lower(salary_period) WHEN 'month' THEN 1 WHEN 'year' THEN 1 WHEN 'hour' THEN 160 END"
SQL_RATE = "CASE upper(salary_currency) WHEN 'USD' THEN 41.5 WHEN 'UAH' THEN 1 WHEN 'EUR' THEN 45.25 END"


@query(
    "m11_salary_points",
    f"SELECT id, CASE WHEN v IS NULL THEN 0 WHEN v >= 1000 * 41.5 * d THEN 5 ELSE -10 END AS points FROM (SELECT id, coalesce(nullif(salary_max, 0), salary_min) * {SQL_PERIOD} * {SQL_RATE} AS v, CASE lower(salary_period) WHEN 'year' THEN 12 ELSE 1 END AS d FROM opportunities) AS x",
)
def m11(t):
    return t.opportunities.select("id", scoring.salary_points(EXAMPLE, RATES).alias("points"))


@query(
    "m2_sanity",
    f"""SELECT id, CASE WHEN kind <> 'employment' THEN 0 WHEN coalesce(salary_min, salary_max) * f > 2000 * 41.5 * d THEN -20 WHEN coalesce(salary_max, salary_min) * f < 400 * 41.5 * d AND regexp_matches(replace(replace(lower(employment_type), '_', ' '), '-', ' '), '(^|[^a-z0-9])full *time($|[^a-z0-9])') THEN -15 ELSE 0 END AS points
  FROM (SELECT *, {SQL_PERIOD} * {SQL_RATE} AS f, CASE lower(salary_period) WHEN 'year' THEN 12 ELSE 1 END AS d FROM opportunities) AS x""",
)
def m2(t):
    return t.opportunities.select("id", scoring.sanity(EXAMPLE, RATES).alias("points"))


PROJECT = """SELECT p_partkey AS id, p_name AS title, p_type AS description, 'x' AS company, array() AS tags, CASE WHEN p_partkey % 2 = 0 THEN 'hourly' ELSE 'fixed' END AS contract_type, CAST(p_size AS DECIMAL(14,2)) AS salary_min,
  CAST(p_size * 4 AS DECIMAL(14,2)) AS salary_max, CAST(1 AS DECIMAL(14,6)) AS usd_rate, CAST(p_partkey % 300 AS INT) AS bid_count, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS payment_verified, CAST(p_partkey % 6 AS DOUBLE) AS rating, CAST(p_partkey % 7 AS INT) AS reviews, false AS truncated FROM {part}"""


@query(
    "m18_m20_project_points",
    f"""WITH p AS ({PROJECT.format(part='part').replace('array()', '[]')}) SELECT id, CASE WHEN contract_type = 'hourly' THEN CASE WHEN salary_min >= 12 THEN 12 WHEN salary_max >= 12 THEN 10 WHEN salary_max >= 8 THEN 5 ELSE 0 END
  ELSE CASE WHEN salary_min >= 5 AND salary_max <= 100 AND coalesce(payment_verified, false) THEN 15 WHEN salary_min >= 150 THEN 10 WHEN salary_max >= 150 THEN 8 WHEN salary_max >= 75 THEN 5 ELSE 0 END END AS budget,
  CASE WHEN bid_count <= 10 THEN 10 WHEN bid_count <= 25 THEN 7 WHEN bid_count <= 50 THEN 3 WHEN bid_count <= 100 THEN -3 WHEN bid_count <= 200 THEN -8 ELSE -15 END AS competition,
  CASE WHEN payment_verified THEN 5 WHEN NOT payment_verified THEN -3 ELSE 0 END + CASE WHEN reviews >= 3 AND rating >= 4.5 THEN 5 WHEN reviews >= 3 AND rating < 3.5 THEN -8 ELSE 0 END AS employer FROM p""",
)
def m18(t):
    parts = scoring.freelance_parts(EXAMPLE)
    return t.spark.sql(PROJECT, part=t.raw("part")).select("id", *[parts[k].alias(k) for k in ("budget", "competition", "employer")])


@query("m22_due_for_evaluation", "SELECT o_orderkey AS id FROM orders LEFT JOIN (SELECT opportunity_id, listing_content_hash FROM evaluations WHERE rules_version = 'v2') AS e ON o_orderkey = opportunity_id WHERE opportunity_id IS NULL OR listing_content_hash <> CAST(o_custkey % 19 AS VARCHAR)")
def m22(t):
    candidates = t.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 19).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("rates_hash"))
    known = t.evaluations.withColumn("exchange_rates_hash", F.lit(None).cast("string"))
    return scoring.due_for_evaluation(candidates, known, "v2").select("id")


@query(
    "m23_compare_rules",
    """SELECT count(*) AS records, count(*) FILTER (a >= 55) AS baseline_main, count(*) FILTER (b >= 55) AS candidate_main, count(*) FILTER (a < 55 AND b >= 55) AS added, count(*) FILTER (a >= 55 AND b < 55) AS removed,
  count(*) FILTER (b BETWEEN 35 AND 54) AS explore, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a <> b AND (a >= 55) = (b >= 55)) AS score_only FROM (SELECT score AS a, CAST((opportunity_id * 41) % 101 AS INT) AS b FROM evaluations) AS x""",
)
def m23(t):
    a = t.evaluations.select(F.col("opportunity_id").alias("id"), "score")
    return scoring.compare_rules(a, a.select("id", (F.col("id") * 41 % 101).cast("int").alias("score")), 55)

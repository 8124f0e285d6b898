"""Source runs: latest runs, streaks, coverage issues and health transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators.predicates import coverage_warning

# Fixed values of the coverage test.
NEWEST, LIMIT_STREAK, BASELINE_RUNS, LEAST_BASELINE, DROP_RATIO = 8, 3, 5, 10, 0.5
MASK = "Source reported an issue. Details are available internally."


def newest(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs of each source, with their place `age` from 1."""
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def sources_report(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its latest run and the run's gravest gap; error texts masked."""
    last = newest(runs, 1).select("source_id", F.col("id").alias("run_id"), "status", "started_at", coverage_warning_or_null(runs).alias("warning"))
    error = F.when(F.coalesce("last_error", F.lit("")) != "", MASK)
    return sources.join(last, sources.id == last.source_id, "left").select(sources.id, "name", "enabled", "run_id", "status", "started_at", "warning", error.alias("error"))


def coverage_warning_or_null(runs: DataFrame) -> Column:
    """The coverage warning over the counters that a table has; the others count nothing."""
    warning = coverage_warning()
    missing = [c for c in ("deferred_count", "filtered_count") if c not in runs.columns]
    if not missing:
        return warning
    return (
        F.when(F.col("limit_reached"), "limit_reached").when(F.col("detail_failure_count") > 0, "detail_failures").when(F.col("discovered_count") == 0, "empty")
    )


def run_ordinal(runs: DataFrame) -> DataFrame:
    """How many earlier runs of its source each run has."""
    return runs.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy("id")) - 1)


def equal_last_two(runs: DataFrame) -> DataFrame:
    """Sources whose two newest finished runs ended alike, and how."""
    two = newest(runs.where("finished_at is not null"), 2).groupBy("source_id").agg(F.count("*").alias("n"), F.min("status").alias("low"), F.max("status").alias("high"))
    return two.where("n = 2 and low = high").select("source_id", F.col("low").alias("status"))


def _issue(limits: Column, counts: Column, shift: int) -> Column:
    """The coverage issue of runs in order of age, the newest ``shift`` left out."""
    at = lambda a, k: F.get(a, F.lit(k + shift))
    repeated = at(limits, 0) & at(limits, 1) & at(limits, 2)
    older = F.slice(counts, 3 + shift, BASELINE_RUNS)
    ordered = F.sort_array(older)
    n = F.size(ordered)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / F.lit(2.0)
    baseline = F.bround(middle)
    enough = (F.size(counts) - shift >= BASELINE_RUNS) & (n > 0)
    drop = enough & (baseline >= LEAST_BASELINE) & (at(counts, 0) <= DROP_RATIO * baseline) & (at(counts, 1) <= DROP_RATIO * baseline)
    return F.when(F.coalesce(repeated, F.lit(False)), "repeated_limit").when(F.coalesce(drop, F.lit(False)), "discovered_drop")


def coverage_issues(runs: DataFrame) -> DataFrame:
    """The present and the preceding coverage issue of each source, over its newest successful runs."""
    order = newest(runs.where("status = 'succeeded'"), NEWEST)
    # at most NEWEST rows a source
    gathered = order.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("age", "limit_reached", "discovered_count"))).alias("r"))
    limits, counts = F.col("r.limit_reached"), F.col("r.discovered_count")
    return gathered.select("source_id", _issue(limits, counts, 0).alias("issue"), _issue(limits, counts, 1).alias("previous"))


def health_events(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The health alert that each source's newest finished run gives rise to; over sources that hold the alert state.

    `sources` has id, failure_alert_active, failure_alert_reason, coverage_alert_active, pending_reason.
    """
    runs = runs.where("finished_at is not null")
    last = newest(runs, 1).select("source_id", "status")
    streak = equal_last_two(runs).select(F.col("source_id").alias("streak_id"), F.lit(True).alias("streak"))
    issues = coverage_issues(runs).withColumnRenamed("source_id", "issue_id")
    joined = sources.join(last, sources.id == last.source_id).join(streak, sources.id == streak.streak_id, "left").join(issues, sources.id == issues.issue_id, "left")
    bad = F.col("status").isin("failed", "partial")
    same = F.col("failure_alert_active") & (F.coalesce("failure_alert_reason", F.lit("failed")) == F.col("status"))
    none = F.lit(None).cast("string")
    known = (F.col("issue") == F.col("previous")) & ~F.equal_null("pending_reason", "issue")
    event = (
        F.when((F.col("status") == "succeeded") & F.col("failure_alert_active"), "recovery")
        .when(bad & F.coalesce(same, F.lit(False)), none)
        .when(bad & F.col("streak"), F.when(F.col("status") == "failed", "failure").otherwise("partial"))
        .when(F.col("status") != "succeeded", none)
        .when(F.col("coverage_alert_active"), F.when(F.col("issue").isNull(), "coverage_recovery"))
        .when(F.col("issue").isNull(), none)
        .when(F.coalesce(known, F.lit(False)), none)
        .otherwise("coverage_issue")
    )
    return joined.select("id", "status", "issue", event.alias("event"))


def diagnostics(runs: DataFrame) -> DataFrame:
    """OK, PARTIAL, EMPTY or FAIL of each source's newest run."""
    state = F.when(F.col("status") == "failed", "FAIL").when((F.col("status") == "partial") | (F.col("error_count") > 0), "PARTIAL").when(F.col("discovered_count") == 0, "EMPTY").otherwise("OK")
    return newest(runs, 1).select("source_id", state.alias("state"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counters a source: created, updated, unchanged, duplicate, failed, and the run's status."""
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "unchanged", "duplicate", "failed")]
    done = outcomes.groupBy("source_id").agg(F.count("*").alias("discovered"), *counted)
    return done.withColumn("status", F.when(F.col("failed") == F.col("discovered"), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded"))


def health_worklist(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_id, run_id) of the newest finished run of each enabled source that has one."""
    last = newest(runs.where("finished_at is not null"), 1).select("source_id", F.col("id").alias("run_id"))
    return sources.where("enabled").select(F.col("id").alias("source_id")).join(last, "source_id")


# The most children and ids that a report shows.
MOST_CHILDREN, MOST_IDS = 16, 10


def _sample(rows: DataFrame, keys: list[str], value: Column, most: int, name: str) -> DataFrame:
    """The smallest values of each key in order, at most so many: rows are ranked, so no more are ever gathered."""
    ranked = rows.select(*keys, value.alias("_v")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).where(F.col("_n") <= most)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias(name))


def consistency_report(reads: DataFrame, missing: DataFrame) -> DataFrame:
    """A bounded report of each parent feed with missing ids.

    Reads have parent, child, outcome (of the first read; null without one), recheck (its outcome; null if none was
    tried) and scheduled; missing has parent, id and remaining, ids once each. Counts cover all; samples show ten
    ids, and sixteen children: those tried again first, then those not processed, then by name.
    """
    done = lambda c: F.coalesce(F.col(c) == "processed", F.lit(False))
    ids = missing.groupBy("parent").agg(F.count("*").alias("missing_count"), F.count_if("remaining").alias("remaining_missing_count"))
    feeds = reads.groupBy("parent").agg(
        F.count("*").alias("children_count"), F.count_if(done("outcome")).alias("initial_children_processed"), F.count_if("scheduled").alias("rechecks_scheduled"),
        F.count("recheck").alias("rechecks_attempted"), F.count_if(done("recheck")).alias("rechecks_processed"),
    )
    child = F.struct(F.col("recheck").isNull().alias("untried"), done("outcome").alias("processed"), "child", "outcome", "recheck", "scheduled")
    shown = _sample(reads, ["parent"], child, MOST_CHILDREN, "children").withColumn("children", F.transform("children", lambda c: F.struct(c["child"].alias("child"), c["outcome"].alias("outcome"), c["scheduled"].alias("scheduled"), c["recheck"].alias("recheck"))))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    out = ids.join(feeds, "parent", "left").join(shown, "parent", "left").join(_sample(missing, ["parent"], F.col("id"), MOST_IDS, "missing_ids"), "parent", "left")
    out = out.join(_sample(missing.where("remaining"), ["parent"], F.col("id"), MOST_IDS, "remaining_missing_ids"), "parent", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("children_count", "initial_children_processed", "rechecks_scheduled", "rechecks_attempted", "rechecks_processed")]
    kind = f"array<{missing.schema['id'].dataType.simpleString()}>"
    return out.select(
        "parent", "missing_count", none("missing_ids", kind), F.greatest(F.lit(0), F.col("missing_count") - MOST_IDS).alias("missing_ids_omitted"), "remaining_missing_count", none("remaining_missing_ids", kind), *counts,
        F.greatest(F.lit(0), F.coalesce("children_count", F.lit(0)) - MOST_CHILDREN).alias("children_omitted"), none("children", shown.schema["children"].dataType.simpleString()),
    )

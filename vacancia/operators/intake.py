"""Runs of sources with isolated errors: judged rows, counters, reconciliation and the run's end.

A bad listing never stops a run: what is wrong with a row is a column, rows without a fault go on, and the others go to quarantine with a
redacted reason. Counters of all sources come from one aggregate, combined before it is shuffled; while one run's rows are written, they can be
observed as well, with no job of their own.

Defined results: a row without an external id or with one that is too long is a fault of its form; a null URL is no trusted link; of repeated rows each is judged and counted; a
source that fetched nothing has a run with zero counts; no sources give no runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vacancia.functions.text import one_decimal, redact
from vacancia.functions.urls import part, trusted
from vacancia.operators import ingest

# Least and most characters of fields, the work modes and kinds that there are, the longest message that is kept.
BOUNDS = {"title": (1, 500), "company": (0, 500), "location_text": (0, 500), "employment_type": (0, 100), "contract_type": (0, 100), "salary_currency": (3, 3), "salary_period": (0, 50)}
WORK_MODES, KINDS = ("remote", "hybrid", "onsite", "flexible", "unknown"), ("employment", "freelance_project")
MOST_MESSAGE, MOST_ID = 2000, 255
OUTCOMES = ("created", "updated", "unchanged", "duplicate")
FETCH = "source_id long, candidates long, filtered long, detail_failures long, metadata_deferred long, pages long, limit_reached boolean, warnings array<string>, terminal_error string, deactivates boolean"


def judge(listings: DataFrame, hosts: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Listings (source_name, external_id, source_url and normalised fields) with ``fault``, null where there is none, and ``reason``, redacted.

    A link outside a source's hosts comes before faults of form; sources without hosts may link anywhere.
    """
    named = {name: allowed for name, allowed in hosts.items() if allowed}
    link = F.lit(False)
    if named:  # a URL is taken apart once, however many sources there are
        own = F.try_element_at(F.create_map(*(x for name, allowed in named.items() for x in (F.lit(name), F.array(*map(F.lit, allowed))))), F.col("source_name"))
        safe = trusted(F.col("source_url"), tuple({h for allowed in named.values() for h in allowed}))
        link = own.isNotNull() & ~(safe & F.coalesce(F.array_contains(own, F.lower(part(F.col("source_url"), 3))), F.lit(False)))
    reason = F.when(link, F.concat(F.lit("Unexpected listing URL for "), "source_name", F.lit(".")))
    size = lambda c: F.length(F.col(c))
    form = F.when(F.coalesce(size("external_id"), F.lit(0)) == 0, "external_id is missing").when(size("external_id") > MOST_ID, "external_id is too long")
    for c, (least, most) in BOUNDS.items():
        if c in listings.columns:
            empty = F.col(c).isNull() if c == "title" else F.lit(False)
            form = form.when(empty | (size(c) < least), f"{c} is too short").when(size(c) > most, f"{c} is too long")
    for c, known in (("work_mode", WORK_MODES), ("kind", KINDS)):
        if c in listings.columns:
            form = form.when(~F.coalesce(F.col(c).isin(*known), F.lit(False)), F.concat(F.lit(f"{c} is unknown: "), F.coalesce(F.col(c), F.lit("null"))))
    # the fault doesn't hang on the redacted reason: who asks for it alone redacts nothing
    return listings.withColumns({"reason": F.substring(redact(F.coalesce(reason, form)), 1, MOST_MESSAGE), "fault": F.when(link, "link").when(form.isNotNull(), "form")})


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("fault is null").drop("fault", "reason")


def quarantine(judged: DataFrame) -> DataFrame:
    return judged.where("fault is not null")


def settled(judged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source_id, external_id, fault, outcome) of judged rows; outcomes (source_id, external_id, outcome) are of accepted ones. A row that got none failed when it was stored."""
    of = outcomes.select("source_id", "external_id", "outcome").dropDuplicates(["source_id", "external_id"])
    joined = judged.select("source_id", "external_id", "fault").join(of, ["source_id", "external_id"], "left")
    return joined.select("source_id", "external_id", "fault", F.when(F.col("fault").isNull(), F.coalesce("outcome", F.lit("failed"))).alias("outcome"))


def _counters() -> list[Column]:
    of = lambda c, v, name: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(name)
    return [F.count("*").alias("discovered"), of("fault", "link", "rejected_links"), of("fault", "form", "normalization_errors"), of("outcome", "failed", "failed"), *(of("outcome", o, o) for o in OUTCOMES)]


def observed(rows: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Settled rows of one run with its counters, which are there once the rows have been written: `observation.get`."""
    seen = Observation(name)
    return rows.observe(seen, *_counters()), seen


def counters(rows: DataFrame, fetches: DataFrame) -> DataFrame:
    """Counters of each fetched source before reconciliation: those of its rows, those that its fetch tells, warnings and errors so far."""
    found = rows.groupBy("source_id").agg(*_counters())
    joined = fetches.join(found, "source_id", "left").fillna(0, ["discovered", "rejected_links", "normalization_errors", "failed", *OUTCOMES, "candidates", "filtered", "detail_failures", "metadata_deferred", "pages"])
    told = F.coalesce("warnings", F.array().cast("array<string>"))
    rejected = F.when(F.col("rejected_links") > 0, F.array(F.concat(F.lit("Rejected "), F.col("rejected_links").cast("string"), F.lit(" listing links outside allowed source domains.")))).otherwise(F.array().cast("array<string>"))
    errors = F.col("rejected_links") + F.col("normalization_errors") + F.col("failed") + F.size(told) + F.col("terminal_error").isNotNull().cast("int")
    return joined.withColumns({"candidates": F.greatest("candidates", "discovered"), "limit_reached": F.coalesce("limit_reached", F.lit(False)), "warnings": F.concat(rejected, told), "errors": errors.cast("long")})


def reconciled(before: DataFrame, listings: DataFrame, seen: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Counters with mode (exact, generic or null), active, missing, blocked: which sources' missing listings may be archived.

    A source that told the ids of its whole inventory (snapshots: source_id, external_id) is compared with these and what it showed, even after
    other errors; another one only after a run without any. Nothing is compared after a fetch that broke off.
    """
    whole = snapshots.where("trim(external_id) <> ''").select("source_id", F.trim("external_id").alias("external_id"))
    has = whole.select("source_id").distinct().withColumn("has_snapshot", F.lit(True))
    clean = F.coalesce("deactivates", F.lit(True)) & (F.col("errors") == 0) & (F.col("detail_failures") == 0) & ~F.col("limit_reached")
    mode = F.when(F.col("terminal_error").isNull(), F.when(F.col("has_snapshot"), "exact").when(clean, "generic"))
    with_mode = before.join(has, "source_id", "left").withColumn("mode", mode).drop("has_snapshot")
    guard = ingest.reconcile(listings, seen.select("source_id", "external_id").unionByName(whole))
    return with_mode.join(guard, "source_id", "left").fillna(0, ["active", "missing"]).fillna(False, ["blocked"])


def finished(state: DataFrame, now: datetime) -> DataFrame:
    """A row for each run: its counters, status and redacted message. A blocked exact comparison makes a run partial, a blocked generic one failed."""
    share = F.concat(one_decimal(F.col("missing") * 100.0 / F.col("active")), F.lit("%"))
    told = F.format_string("Source inventory reconciliation was blocked: %d of %d active listings disappeared (%s).", "missing", "active", share)
    blocked = F.col("mode").isNotNull() & F.col("blocked")
    generic = blocked & (F.col("mode") == "generic")
    terminal = F.when(generic, told).otherwise(F.col("terminal_error"))
    warnings = F.when(blocked & (F.col("mode") == "exact"), F.array_append("warnings", told)).otherwise(F.col("warnings"))
    out = state.withColumns({"terminal": terminal, "warnings": warnings, "errors": F.col("errors") + blocked.cast("int"), "deactivated": F.when(F.col("mode").isNotNull() & ~F.col("blocked"), F.col("missing")).otherwise(0)})
    message = F.coalesce("terminal", F.array_join("warnings", "; "))
    status = F.when(F.col("terminal").isNotNull(), "failed").when(F.col("errors") > 0, "partial").otherwise("succeeded")
    counts = ["discovered", "candidates", "filtered", "detail_failures", "metadata_deferred", "pages", "limit_reached", "created", "updated", "unchanged", "duplicate", "deactivated", "normalization_errors"]
    return out.select("source_id", status.alias("status"), F.lit(now).alias("finished_at"), *counts, F.size("warnings").cast("long").alias("warning_count"), "errors", F.nullif(F.substring(redact(message), 1, MOST_MESSAGE), F.lit("")).alias("error_message"))


def archived(listings: DataFrame, state: DataFrame, seen: DataFrame, snapshots: DataFrame, now: datetime) -> DataFrame:
    """Listings after the runs: those missing from compared sources are archived, those shown are active again."""
    shown = seen.select("source_id", "external_id").distinct().withColumn("shown", F.lit(True))
    whole = snapshots.select("source_id", F.trim("external_id").alias("external_id")).distinct().withColumn("listed", F.lit(True))
    modes = state.where("mode is not null and not blocked").select("source_id", "mode")
    joined = listings.join(modes, "source_id", "left").join(shown, ["source_id", "external_id"], "left").join(whole, ["source_id", "external_id"], "left")
    gone = F.coalesce(F.col("is_active"), F.lit(False)) & F.col("mode").isNotNull() & F.col("shown").isNull() & F.col("listed").isNull()
    back = F.coalesce("shown", F.lit(False))
    values = {"is_active": F.when(gone, False).when(back, True).otherwise(F.col("is_active")), "archive_reason": F.when(gone, F.when(F.col("mode") == "exact", "source_closed").otherwise("missing")).when(back, None).otherwise(F.col("archive_reason"))}
    if "archived_at" in listings.columns:
        values["archived_at"] = F.when(gone, F.lit(now)).when(back, None).otherwise(F.col("archived_at"))
    return joined.withColumns(values).select(listings.columns)


def source_states(sources: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Sources after their runs: last_run_at, last_success_at and last_error. Sources without a run stay as they are."""
    told = runs.select(F.col("source_id").alias("id"), "status", "error_message")
    joined = sources.join(told, "id", "left")
    ran, well = F.col("status").isNotNull(), F.col("status").isin("succeeded", "partial")
    error = F.when(F.col("status") == "failed", F.coalesce("error_message", F.lit("Unknown error"))).when(F.col("status") == "partial", F.col("error_message"))
    values = {"last_run_at": F.when(ran, F.lit(now)).otherwise(F.col("last_run_at")), "last_success_at": F.when(ran & well, F.lit(now)).otherwise(F.col("last_success_at")), "last_error": F.when(ran, error).otherwise(F.col("last_error"))}
    return joined.withColumns(values).select(sources.columns)

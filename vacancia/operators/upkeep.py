"""Evaluations, message registry, preferences, cursors and backfills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.text import canonical_key, quality_score
from vacancia.operators.ingest import merge
from vacancia.operators.listings import best_canonical

EVALUATION_KEY = ["opportunity_id", "profile_id", "rules_version"]


def upsert_evaluations(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, EVALUATION_KEY)


def record_messages(registry: DataFrame, sent: DataFrame) -> DataFrame:
    """The message registry after sending: known messages come alive again."""
    return merge(registry, sent.withColumn("deleted_at", F.lit(None).cast("timestamp")), ["telegram_message_id"])


def mark_deleted(registry: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    gone = ids.select("telegram_message_id", F.lit(True).alias("_gone")).distinct()
    joined = registry.join(gone, "telegram_message_id", "left")
    return joined.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))).drop("_gone")


def active_messages(registry: DataFrame) -> DataFrame:
    return registry.where("deleted_at is null").select("telegram_message_id").orderBy(F.desc("telegram_message_id"))


def set_paused(preferences: DataFrame, profile_id: str, channel: str, paused: bool, now: datetime) -> DataFrame:
    """Preferences after a pause or a resumption."""
    spark = preferences.sparkSession
    row = spark.range(1).select(F.lit(profile_id).alias("profile_id"), F.lit(channel).alias("channel"), F.lit(paused).alias("is_paused"), F.lit(now).alias("at"))
    own = (F.col("profile_id") == profile_id) & (F.col("channel") == channel)
    changed = preferences.where(own).select("profile_id", "channel", F.lit(paused).alias("is_paused"), (F.lit(now) if paused else F.col("paused_at")).alias("paused_at"), (F.col("resumed_at") if paused else F.lit(now)).alias("resumed_at"))
    none = F.lit(None).cast("timestamp")
    fresh = row.join(preferences.where(own), ["profile_id", "channel"], "left_anti").select("profile_id", "channel", "is_paused", (F.col("at") if paused else none).alias("paused_at"), (none if paused else F.col("at")).alias("resumed_at"))
    return preferences.where(~own).unionByName(changed).unionByName(fresh)


def verify_snapshot(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Row counts of tables in two snapshots, and whether they agree."""
    parts = [before[n].agg(F.count("*").alias("before")).crossJoin(after[n].agg(F.count("*").alias("after"))).select(F.lit(n).alias("name"), "before", "after") for n in sorted(before)]  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("equal", F.col("before") == F.col("after"))


def backfill_quality(listings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Listings with the normalised snapshot of their opportunity as JSON, and its quality score."""
    o = opportunities.withColumnRenamed("id", "opportunity_id")
    shown = ["title", "company", "description", "location_text", "work_mode", "salary_min", "salary_max", "salary_currency", "salary_period"]
    score = quality_score(F.col("description"), F.col("salary_min"), F.col("salary_max"), F.col("company"), F.col("location_text"), F.col("salary_currency"), F.col("salary_period"))
    filled = o.select("opportunity_id", F.to_json(F.struct(*shown)).alias("normalized_data"), score.alias("quality_score"))
    return listings.drop("normalized_data", "quality_score").join(filled, "opportunity_id")


def backfill_skills(evaluations: DataFrame, prefix: str) -> DataFrame:
    """Evaluations with matched_skills read out of the reason that lists them."""
    listed = F.get(F.filter("reasons", lambda r: F.startswith(r, F.lit(prefix))), F.lit(0))
    names = F.transform(F.split(F.rtrim(F.substring(listed, len(prefix) + 1, 10_000), F.lit(".")), ","), lambda s: F.trim(s))
    return evaluations.withColumn("matched_skills", F.coalesce(F.filter(names, lambda s: s != ""), F.array().cast("array<string>")))


def backfill_dates(listings: DataFrame, sources: DataFrame, opportunities: DataFrame, source: str) -> DataFrame:
    """Opportunities after one source's dates turned out to be update dates: the best listing's dates are taken anew."""
    known = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"))
    repaired = listings.join(known, "source_id").withColumns({"source_updated_at": F.when(F.col("_name") == source, F.col("published_at")), "published_at": F.when(F.col("_name") != source, F.col("published_at"))}).drop("_name")
    top = best_canonical(repaired, sources).select(F.col("opportunity_id").alias("id"), F.col("published_at").alias("_p"), F.col("source_updated_at").alias("_u"), F.lit(True).alias("_has"))
    joined = opportunities.join(top, "id", "left")
    pick = lambda new, old: F.when(F.col("_has"), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"published_at": pick("_p", "published_at"), "source_updated_at": pick("_u", "source_updated_at")}).select(opportunities.columns)


def backfill_archive(listings: DataFrame) -> DataFrame:
    """Inactive listings without a reason are missing ones."""
    return listings.withColumn("archive_reason", F.when(~F.col("is_active"), F.coalesce("archive_reason", F.lit("missing"))))


def with_key(opportunities: DataFrame) -> DataFrame:
    return opportunities.withColumn("canonical_key", canonical_key(F.col("company"), F.col("title"), F.col("location_text"), F.col("work_mode")))


def repoint_messages(messages: DataFrame, merges: DataFrame) -> DataFrame:
    """Messages of merged deliveries, pointing at the ones that stay."""
    into = merges.select(F.col("id").alias("delivery_id"), F.col("into").alias("_into"))
    return messages.join(into, "delivery_id", "left").withColumn("delivery_id", F.coalesce("_into", "delivery_id")).drop("_into").select(messages.columns)


def snapshot_ids(rows: DataFrame) -> DataFrame:
    """Trimmed non-empty ids of a full snapshot; without any, no rows, which means no reconciliation."""
    return rows.select(F.trim("external_id").alias("external_id")).where("external_id <> ''").distinct()


def disposition_of(opportunities: DataFrame, states: DataFrame) -> DataFrame:
    known = states.select(F.col("opportunity_id").alias("id"), "disposition")
    return opportunities.select("id").join(known, "id", "left").select("id", F.coalesce("disposition", F.lit("new")).alias("disposition"))


def rechecks(children: DataFrame, most: int) -> DataFrame:
    """(parent, child) to check again: the parents in turn give their next child, a child that several share once, at most ``most``.

    A child belongs to the parent at which its turn comes first.
    """
    turn = F.row_number().over(Window.partitionBy("parent").orderBy("position"))
    first = children.withColumn("turn", turn)
    own = first.withColumn("rank", F.row_number().over(Window.partitionBy("child").orderBy("turn", "parent"))).where("rank = 1")
    return own.orderBy("turn", "parent").limit(most).select("parent", "child")


def begin_cycles(cursors: DataFrame, started: DataFrame) -> DataFrame:
    """Cursors (profile_id, channel, minimum_first_seen_at) with those of cycles that start for the first time; known ones stay."""
    return cursors.unionByName(started.join(cursors.select("profile_id", "channel"), ["profile_id", "channel"], "left_anti"))


def complete_cycles(cursors: DataFrame, completed: DataFrame) -> DataFrame:
    """Cursors moved to the starts of the cycles that ended; an ended cycle without a cursor fails the job."""
    keys = ["profile_id", "channel"]
    ended = completed.select(*keys, F.col("minimum_first_seen_at").alias("_at"))
    joined = cursors.join(ended, keys, "full_outer")
    lost = F.raise_error(F.lit("a completed cycle has no cursor")).cast("timestamp")
    return joined.select(*keys, F.when(F.col("minimum_first_seen_at").isNull(), lost).otherwise(F.coalesce("_at", "minimum_first_seen_at")).alias("minimum_first_seen_at"))

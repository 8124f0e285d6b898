"""Set-based ingestion, reconciliation, expiry and merges of snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators import dedup
from vacancia.operators.lineage import stored, written
from vacancia.operators.predicates import expiration_action

MISSING_GUARD = (4, 5)  # the share of missing listings above which nothing is deactivated, as a fraction


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A snapshot after an upsert: new values win, but for the columns in ``keep``, which only new rows bring."""
    o, n = old.alias("o"), new.alias("n")
    matched = F.lit(True)
    for k in keys:
        matched = matched & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    joined = o.join(n, matched, "full_outer")
    has_new = F.col(f"n.{keys[0]}").isNotNull()
    columns = []
    for c in old.columns:
        if c in keys or c in keep:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c))
        elif c in new.columns:
            columns.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.col(f"o.{c}").alias(c))
    return joined.select(columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot with the new rows whose key it lacks; the first of equal new keys."""
    return old.unionByName(new.join(old.select(keys), keys, "left_anti").dropDuplicates(keys))


def surrogate_ids(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """Consecutive ids after ``start`` in a stated order. Ranges are numbered in parallel; only their sizes are summed up.

    Bounds of ranges come from a sample, so the rows with their ranges are cut off by a checkpoint before both uses.
    """
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    placed = stored(placed)
    within = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = within.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(before, "_range").withColumn("id", F.lit(start) + F.coalesce("_before", F.lit(0)) + F.col("_n")).drop("_range", "_n", "_size", "_before")


def outcomes(incoming: DataFrame, listings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """created, duplicate, unchanged or updated for each incoming listing, with the opportunity it belongs to.

    Incoming has source_id, external_id, content_hash, canonical_key and what `dedup.confident` compares; listings the
    first three, is_active and opportunity_id; opportunities id, kind, canonical_key and what is compared. A new
    listing of a job is a duplicate of the first opportunity of its key that passes the pair test and has an active
    listing of another source.
    """
    known = listings.select("source_id", "external_id", F.col("content_hash").alias("known_hash"), F.col("opportunity_id").alias("known_opportunity"))
    # an anti join goes below what gives the incoming rows their columns
    new = incoming.join(known.where("known_hash is not null").select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    first = cross_source(new, listings, opportunities)
    joined = incoming.join(known, ["source_id", "external_id"], "left").join(first, ["source_id", "external_id"], "left")
    outcome = F.when(F.col("known_hash").isNull(), F.when(F.col("candidate").isNotNull(), "duplicate").otherwise("created")).when(F.col("known_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return joined.select("source_id", "external_id", outcome.alias("outcome"), F.coalesce("known_opportunity", "candidate").alias("opportunity_id"))


def cross_source(incoming: DataFrame, listings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(source_id, external_id, candidate) of incoming jobs that an opportunity of another source already stands for."""
    ready = lambda rows, *kept: dedup.postings(rows.where("kind = 'employment'"), *kept, more_keys=("canonical_key",))
    # of the active sources of an opportunity, two suffice to say whether another source than one's own has it
    owners = listings.where("is_active").groupBy("opportunity_id").agg(F.min("source_id").alias("low"), F.max("source_id").alias("high"))
    owned = opportunities.join(owners, F.col("id") == F.col("opportunity_id")).drop("opportunity_id")
    new, old = written(ready(incoming, "source_id", "external_id")), written(ready(owned, "id", "low", "high"))
    foreign = (F.col("y.low") != F.col("x.source_id")) | (F.col("y.high") != F.col("x.source_id"))
    return dedup.matched(new, old).where(foreign).groupBy("x.source_id", "x.external_id").agg(F.min("y.id").alias("candidate"))


def reconcile(listings: DataFrame, seen: DataFrame, reason: str = "missing") -> DataFrame:
    """Per source: active, missing, and whether the missing ones may be deactivated; seen has source_id, external_id."""
    active = listings.where("is_active").select("source_id", "external_id")
    met = seen.select("source_id", "external_id", F.lit(True).alias("met")).distinct()
    counted = active.join(met, ["source_id", "external_id"], "left").groupBy("source_id").agg(F.count("*").alias("active"), F.count_if(F.col("met").isNull()).alias("missing"))
    any_seen = seen.select("source_id").distinct().withColumn("any_seen", F.lit(True))
    num, den = MISSING_GUARD
    blocked = (F.col("missing") > 0) & (F.col("any_seen").isNull() | (F.col("missing") * den > F.col("active") * num))
    return counted.join(any_seen, "source_id", "left").select("source_id", "active", "missing", blocked.alias("blocked"))


def deactivate_missing(listings: DataFrame, seen: DataFrame, now: datetime, reason: str = "missing") -> DataFrame:
    """The listings after reconciliation; seen ones are active again."""
    guard = reconcile(listings, seen, reason).select("source_id", "blocked")
    met = seen.select("source_id", "external_id", F.lit(True).alias("met")).distinct()
    joined = listings.join(guard, "source_id", "left").join(met, ["source_id", "external_id"], "left")
    off = F.col("is_active") & F.col("met").isNull() & ~F.coalesce("blocked", F.lit(True))
    on = F.col("met").isNotNull()
    state = {"is_active": F.when(off, False).when(on, True).otherwise(F.col("is_active")), "archive_reason": F.when(off, reason).when(on, None).otherwise(F.col("archive_reason"))}
    return joined.withColumns(state).select(listings.columns)


def expire(listings: DataFrame, opportunities: DataFrame, cutoffs: Mapping[str, datetime]) -> DataFrame:
    """The listings after expiry and restoration, with the `action` that each underwent."""
    kinds = opportunities.select(F.col("id").alias("opportunity_id"), "kind")
    acted = listings.join(kinds, "opportunity_id").withColumn("action", expiration_action(cutoffs))
    active = F.when(F.col("action") == "expire", False).when(F.col("action") == "restore", True).otherwise(F.col("is_active"))
    reason = F.when(F.col("action") == "expire", "expired").when(F.col("action") == "restore", None).otherwise(F.col("archive_reason"))
    return acted.withColumns({"is_active": active, "archive_reason": reason})


def enable_only(sources: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return sources.withColumn("enabled", F.col("name").isin(*names))


def set_disposition(states: DataFrame, changes: DataFrame) -> DataFrame:
    """User states after changes (opportunity_id, disposition); `new` takes a state away."""
    return merge(states.select("opportunity_id", "disposition"), changes, ["opportunity_id"]).where("disposition <> 'new'")

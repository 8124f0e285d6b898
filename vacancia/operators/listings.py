"""Best listings, visibility and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.text import canonical_key
from vacancia.operators.predicates import active_listing, page_bounds

Hosts = Mapping[str, tuple[str, ...]]


def with_source(listings: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select(F.col("id").alias("source_id"), "name", "enabled")
    return listings.join(named, "source_id")


def best(listings: DataFrame) -> DataFrame:
    """The listing of the highest quality of each opportunity, the lower id among equals."""
    ranked = listings.withColumn("rank", F.row_number().over(Window.partitionBy("opportunity_id").orderBy(F.desc("quality_score"), F.asc("id"))))
    return ranked.where("rank = 1").drop("rank")


# Three notions of the best listing, which differ on purpose.
def best_canonical(listings: DataFrame, sources: DataFrame) -> DataFrame:
    return best(with_source(listings, sources).where("is_active and enabled and normalized"))


def best_for_matching(listings: DataFrame, sources: DataFrame) -> DataFrame:
    return best(with_source(listings, sources).where("is_active and enabled"))


def best_link(listings: DataFrame, sources: DataFrame, hosts: Hosts, source: str | None = None) -> DataFrame:
    return best(with_source(listings, sources).where(active_listing(hosts, source)))


def visible(rows: DataFrame, key: str, listings: DataFrame, sources: DataFrame, hosts: Hosts, states: DataFrame, source: str | None = None) -> DataFrame:
    """Rows whose opportunity has an active trusted listing and is not hidden."""
    active = with_source(listings, sources).where(active_listing(hosts, source)).select(F.col("opportunity_id").alias("active_id"))
    hidden = states.where("disposition = 'hidden'").select(F.col("opportunity_id").alias("hidden_id"))
    return rows.join(active, F.col(key) == F.col("active_id"), "left_semi").join(hidden, F.col(key) == F.col("hidden_id"), "left_anti")


def recency() -> Column:
    return F.coalesce("source_updated_at", "published_at", "first_seen_at")


def order_of(sort: str) -> list[Column]:
    return {
        "recent": [F.desc("recency"), F.desc("id")],
        "score": [F.desc("score"), F.desc("recency"), F.desc("id")],
        "newest": [F.desc("recency"), F.desc("score"), F.desc("id")],
        "company": [F.asc(F.col("company").isNull()), F.asc_nulls_last(F.lower("company")), F.desc("score"), F.desc("id")],
    }[sort]


def page(rows: DataFrame, sort: str, limit: int, offset: int) -> DataFrame:
    """A slice in order: a bounded top-k, not a sort of all rows."""
    limit, offset = page_bounds(limit, offset)
    return rows.withColumn("recency", recency()).orderBy(*order_of(sort)).offset(offset).limit(limit)


def page_with_links(rows: DataFrame, sort: str, limit: int, offset: int, listings: DataFrame, sources: DataFrame, hosts: Hosts, source: str | None = None) -> DataFrame:
    """The page first, its links second, its order again: links are ranked for the page's rows alone."""
    chosen = page(rows, sort, limit, offset)
    # at most MAX_PAGE rows, which ride along so that the page is made once
    paged = F.broadcast(chosen.select(F.col("id").alias("opportunity_id"), F.struct("*").alias("page")))
    near = with_source(listings, sources).where(active_listing(hosts, source)).select("opportunity_id", "id", "quality_score", "name", "source_url").join(paged, "opportunity_id")
    return best(near).select("page.*", F.col("name").alias("source_name"), "source_url", "quality_score").orderBy(*order_of(sort))


def refresh_canonical(opportunities: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Each opportunity with its canonical listing, `stale` where none is left.

    Where listings hold a `snapshot` struct of normalised fields, those of the canonical listing replace the
    opportunity's, nulls too, and its canonical key is made again; a stale opportunity keeps what it had.
    """
    # chosen by narrow rows; only the chosen listings' snapshots are joined
    top = best_canonical(listings.select("id", "opportunity_id", "source_id", "quality_score", "is_active", "normalized"), sources)
    top = top.select("opportunity_id", F.col("id").alias("canonical_listing_id"), F.col("quality_score").alias("canonical_quality"))
    copied = []
    if "snapshot" in listings.columns:
        inner = listings.schema["snapshot"].dataType.fieldNames()
        copied = [c for c in opportunities.columns if c in inner and c != "id"]
        top = top.join(listings.select(F.col("id").alias("canonical_listing_id"), "snapshot"), "canonical_listing_id").dropDuplicates(["opportunity_id"])
    joined = opportunities.join(top, opportunities.id == top.opportunity_id, "left").drop("opportunity_id")
    left = F.col("canonical_listing_id").isNotNull()
    fields = {c: F.when(left, F.col(f"snapshot.{c}")).otherwise(F.col(c)) for c in copied}
    out = joined.withColumns(fields | {"status": F.when(left, "active").otherwise("stale")})
    if copied and "canonical_key" in opportunities.columns:
        key = canonical_key(F.col("company"), F.col("title"), F.col("location_text"), F.col("work_mode"))
        out = out.withColumn("canonical_key", F.when(left, key).otherwise(F.col("canonical_key")))
    return out.drop("snapshot")

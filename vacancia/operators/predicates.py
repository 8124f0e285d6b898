"""Predicates over listings, opportunities, runs and deliveries."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import escape_like
from vacancia.functions.urls import trusted_listing

# Spellings of employment types; bounds of the explore scores; limits of pages.
EMPLOYMENT_ALIASES = {
    "full_time": ("full_time", "fulltime", "fulltime_permanent", "full_time_permanent"),
    "part_time": ("part_time", "parttime"),
    "contractor": ("contractor", "contract"),
    "temporary": ("temporary", "temp"),
    "internship": ("internship", "intern"),
}
EXPLORE = (35, 54)
MAX_PAGE, MAX_OFFSET = 200, 100_000


def active_listing(hosts: Mapping[str, tuple[str, ...]], source: str | None = None) -> Column:
    """Active, of an enabled source, trusted, and of the named source if any; over listings joined to sources."""
    ok = F.col("is_active") & F.col("enabled") & trusted_listing(F.col("name"), F.col("source_url"), hosts)
    return ok & (F.col("name") == source) if source else ok


def text_search(q: str, *columns: str) -> Column:
    """Whether any column holds the text, whatever its case; wildcards are ordinary characters."""
    pattern = f"%{escape_like(q)}%"
    hits = [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns]
    return hits[0] if len(hits) == 1 else F.exists(F.array(*hits), lambda h: h)


def employment_type(wanted: str, column: str = "employment_type") -> Column:
    key = wanted.strip().lower().replace("-", "_").replace(" ", "_")
    aliases = EMPLOYMENT_ALIASES.get(key, (key,))
    stored = F.split(F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), "-", "_"), " ", ""), ",")
    return F.arrays_overlap(stored, F.array(*map(F.lit, aliases)))


def minimum_salary(least: float, currency: str) -> Column:
    return (F.coalesce("salary_max", "salary_min") >= least) & (F.upper("salary_currency") == currency.upper()) & (F.lower("salary_period") == "month")


def score_between(low: int, high: int) -> Column:
    if high < low:
        raise ValueError("max_score must not be less than min_score")
    return F.col("score").between(low, high)


def explore_eligible(minimum: int, since: datetime) -> Column:
    explore = F.col("score").between(*EXPLORE)
    return (F.col("score") >= minimum) & ~explore | explore & (F.col("first_seen_at") >= F.lit(since))


def in_notification_window(cursor: datetime, explore_since: datetime) -> Column:
    cutoff = F.when(F.col("score").between(*EXPLORE), F.lit(explore_since)).otherwise(F.lit(cursor))
    return F.col("first_seen_at") >= cutoff


def expiration_action(cutoffs: Mapping[str, datetime]) -> Column:
    """`expire`, `restore` or null, by kind: over listings joined to their opportunity's kind."""
    date = F.coalesce("published_at", "first_seen_at")
    restorable = ~F.col("is_active") & (F.col("archive_reason").isNull() | (F.col("archive_reason") == "missing"))
    out = F.lit(None).cast("string")
    for kind, cutoff in cutoffs.items():
        due = F.col("kind") == kind
        out = F.when(due & F.col("is_active") & (date <= F.lit(cutoff)), "expire").when(due & restorable & (date > F.lit(cutoff)), "restore").otherwise(out)
    return out


def retry_due(now: datetime) -> Column:
    """Due deliveries, over rows that say whether the opportunity is hidden."""
    waiting = F.col("status").isin("queued", "failed") & F.col("message_text").isNotNull() & F.col("source_url").isNotNull()
    shown = (F.col("status") == "failed") | ~F.col("hidden")
    return waiting & shown & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now)))


def jittered_seconds(name: Column, last: Column, interval: int, ratio: float) -> Column:
    """The interval stretched or shrunk by up to ``ratio``, as a hash of the name and the last start decides."""
    digits = F.sha2(F.concat(name, F.lit(":"), F.date_format(last, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), 256)
    share = F.conv(F.substring(digits, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)
    return F.greatest(F.lit(1), F.bround(F.lit(float(interval)) * ((1 - ratio) + 2 * ratio * share)).cast("int"))


def source_due(now: datetime, name: Column, last: Column, interval: int, ratio: float) -> Column:
    return last.isNull() | (F.lit(now) >= last + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), jittered_seconds(name, last, interval, ratio)))


def reusable_detail(now: datetime, hours: int, *required: str) -> Column:
    """Fetched within the time to live, same fingerprint, and nothing required is empty."""
    ok = (F.col("detail_fetched_at") > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("fingerprint") == F.col("known_fingerprint"))
    for c in required:
        ok = ok & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return F.coalesce(ok, F.lit(False))


def coverage_warning() -> Column:
    """The gravest gap of a run."""
    return (
        F.when(F.col("limit_reached"), "limit_reached")
        .when(F.col("detail_failure_count") > 0, "detail_failures")
        .when(F.coalesce(F.col("deferred_count"), F.lit(0)) > 0, "deferred")
        .when((F.col("discovered_count") > 0) & (F.col("filtered_count") == F.col("discovered_count")), "all_filtered")
        .when(F.col("discovered_count") == 0, "empty")
    )


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= MAX_PAGE or not 0 <= offset <= MAX_OFFSET:
        raise ValueError("page bounds")
    return limit, offset


def optional_filter(value: str | None) -> str | None:
    if value is None:
        return None
    value = value.strip()
    if len(value) < 2:
        raise ValueError("a filter needs two characters or more")
    return value

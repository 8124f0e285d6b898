"""Feeds and search batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.functions import dates
from vacancia.functions.text import fold, headline
from vacancia.functions.urls import path_id, trusted

ITEM = "title string, link string, description string, pubDate string, guid string, category array<string>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, one row each, with the file they stand in."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return rows.withColumn("feed", F.input_file_name())


def postings(items: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Feed items as postings: trusted, titled, first of each id within its feed, with what a headline says."""
    rows = items.where(trusted(F.col("link"), hosts) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    rows = rows.withColumns({"external_id": path_id(F.col("link")), "head": headline(F.trim("title")), "published_at": dates.rfc822(F.col("pubDate"))})
    return rows.select("feed", "external_id", F.col("link").alias("source_url"), "head.title", "head.company", "head.details", "description", "published_at", "category").dropDuplicates(["feed", "external_id"])


def union_feeds(rows: DataFrame, cached: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of several feeds (feed_order, position, external_id): the first of each id, new ones before cached ones, at most ``most``; and whether any were left out."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("external_id").orderBy("feed_order", "position"))).where("_n = 1").drop("_n")
    known = cached.select("external_id").distinct().withColumn("is_cached", F.lit(True))
    marked = first.join(known, "external_id", "left").withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
    return marked.orderBy("is_cached", "feed_order", "position").limit(most), first.agg((F.count("*") > most).alias("limit_reached"))


def overlay(current: DataFrame, previous: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Current items with the fields that only a fetched page gives taken from the previous snapshot, and its description where the feed has none."""
    old = previous.select("external_id", *[F.col(c).alias(f"_{c}") for c in kept], F.col("description").alias("_description"))
    joined = current.join(old, "external_id", "left")
    fields = {c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in current.columns else F.col(f"_{c}") for c in kept}
    return joined.withColumns(fields | {"description": F.coalesce(F.nullif(F.trim("description"), F.lit("")), "_description")}).drop(*[f"_{c}" for c in kept], "_description")


def detail_due(rows: DataFrame, now: Column, hours: int, most: int) -> DataFrame:
    """The rows whose page is to be fetched: never seen, out of date, or changed since; the most urgent first."""
    reason = F.when(F.col("checked_at").isNull(), 0).when(F.col("source_updated_at") > F.col("checked_at"), 1).when(F.col("checked_at") < now - F.expr(f"INTERVAL {hours} HOURS"), 2)
    return rows.withColumn("priority", reason).where(F.col("priority").isNotNull()).orderBy("priority", F.asc_nulls_first("checked_at"), "external_id").limit(most)


def with_details(cards: DataFrame, fetched: DataFrame, cached: DataFrame) -> DataFrame:
    """Cards with the description of a fetched page, else of the cache, else their own summary, and which it is."""
    new = fetched.select("external_id", F.col("description").alias("_new"))
    old = cached.where(F.coalesce("detail_status", F.lit("")) != "summary").select("external_id", F.col("description").alias("_old"))
    joined = cards.join(new, "external_id", "left").join(old, "external_id", "left")
    status = F.when(F.col("_new").isNotNull(), "complete").when(F.col("_old").isNotNull(), "cached").otherwise("summary")
    return joined.withColumn("detail_status", status).withColumn("description", F.coalesce("_new", "_old", "summary")).drop("_new", "_old")


def search_batch(searches: DataFrame, most: int, run: int, pinned: int, total: int) -> DataFrame:
    """Of searches numbered from 0 by ``position``, the pinned ones and a window over the others that moves on with each run."""
    size, others = max(most - pinned, 0), max(total - pinned, 0)
    if others <= size:
        return searches.orderBy("position")
    turn = F.pmod(F.col("position") - pinned - run * size, F.lit(others))
    return searches.where((F.col("position") < pinned) | (turn < size)).orderBy(F.when(F.col("position") < pinned, F.col("position") - pinned).otherwise(turn))


def ordered_distinct(lists: Sequence[Sequence[str]]) -> list[str]:
    """Search texts of several lists, each once, in the order of first mention, whatever their case."""
    found: dict[str, str] = {}
    for text in (x.strip() for one in lists for x in one):
        found.setdefault(text.casefold(), text)
    return [t for t in found.values() if t]


def ignores_category(items: DataFrame, expected: str) -> DataFrame:
    """Feeds that were asked for a category and hold items, none of which carries it."""
    has = F.exists(F.coalesce("category", F.array().cast("array<string>")), lambda c: fold(F.trim(c)) == expected.strip().casefold())
    return items.groupBy("feed").agg((~F.max(has)).alias("ignored"))


def split_gap(pairs: DataFrame) -> DataFrame:
    """Ids of parent feeds that none of their partitions holds; pairs has parent, child (null for the parent's own rows) and external_id."""
    own = pairs.where("child is null").select("parent", "external_id").distinct()
    return own.join(pairs.where("child is not null").select("parent", "external_id").distinct(), ["parent", "external_id"], "left_anti")

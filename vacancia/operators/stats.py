"""Counters, favourites and notification candidates over opportunities."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.operators import listings as ls
from vacancia.operators.predicates import explore_eligible

Hosts = Mapping[str, tuple[str, ...]]


def stats(opportunities: DataFrame, listings: DataFrame, sources: DataFrame, evaluations: DataFrame, states: DataFrame, rules: str, threshold: int) -> DataFrame:
    """Seven counters in one row."""
    active = ls.with_source(listings, sources).where("is_active and enabled").select(F.col("opportunity_id").alias("id")).distinct()
    hidden = states.where("disposition = 'hidden'").select(F.col("opportunity_id").alias("id"))
    collected = opportunities.agg(F.count("*").alias("collected"))
    with_active = opportunities.join(active, "id", "left_semi").agg(F.count("*").alias("active"))
    own = evaluations.where(F.col("rules_version") == rules).withColumnRenamed("opportunity_id", "id").join(active, "id", "left_semi").join(hidden, "id", "left_anti")
    scored = own.agg(F.count("*").alias("evaluated_active"), F.count_if(F.col("score") >= threshold).alias("matched"))
    chosen = states.agg(F.count_if(F.col("disposition") == "favorite").alias("favorites"), F.count_if(F.col("disposition") == "hidden").alias("hidden"))
    one = collected.crossJoin(with_active).crossJoin(scored).crossJoin(chosen)  # one row each
    return one.withColumn("filtered", F.greatest(F.lit(0), F.col("evaluated_active") - F.col("matched")))


def favorites(states: DataFrame, opportunities: DataFrame, listings: DataFrame, sources: DataFrame, evaluations: DataFrame, hosts: Hosts, rules: str) -> DataFrame:
    """Favourite opportunities, the last changed first, with their link and score where there are any."""
    own = states.where("disposition = 'favorite'").withColumnRenamed("opportunity_id", "favorite_id").drop("disposition")
    links = ls.best_link(listings, sources, hosts).select(F.col("opportunity_id").alias("linked_id"), F.col("name").alias("source_name"), "source_url")
    scores = evaluations.where(F.col("rules_version") == rules).select(F.col("opportunity_id").alias("scored_id"), "score")
    rows = opportunities.join(own, F.col("id") == F.col("favorite_id")).join(links, F.col("id") == F.col("linked_id"), "left").join(scores, F.col("id") == F.col("scored_id"), "left")
    return rows.orderBy(F.desc("changed"), F.desc("id"))


def candidates(evaluations: DataFrame, opportunities: DataFrame, listings: DataFrame, sources: DataFrame, states: DataFrame, hosts: Hosts, minimum: int, since: datetime) -> DataFrame:
    """What may be announced: eligible by score and date, not hidden, with a trusted link; the best first."""
    hidden = states.where("disposition = 'hidden'").select(F.col("opportunity_id").alias("hidden_id"))
    eligible = evaluations.join(opportunities, F.col("opportunity_id") == F.col("id")).where(explore_eligible(minimum, since)).join(hidden, F.col("id") == F.col("hidden_id"), "left_anti").drop("opportunity_id")
    links = ls.best_link(listings, sources, hosts).select("opportunity_id", F.col("name").alias("source_name"), "source_url")
    return eligible.join(links, F.col("id") == F.col("opportunity_id")).orderBy(F.desc("score"), F.desc("id"))

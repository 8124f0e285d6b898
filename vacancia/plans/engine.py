"""One entry point over an engine's tables: pages of jobs and matches, reports, evaluation, deduplication and upkeep."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.profile import Profile
from vacancia.operators import dedup, ingest, listings, predicates, runs, scoring, stats
from vacancia.operators.lineage import stored

TABLES = ("sources", "listings", "opportunities", "evaluations", "user_states", "runs", "deliveries")


class Engine:
    """Queries over named DataFrames. Every method is lazy and returns a DataFrame; `write` stores a snapshot."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], profile: Profile, hosts: Mapping[str, tuple[str, ...]], rates: Mapping[str, Decimal]):
        self.spark, self.tables, self.profile, self.hosts, self.rates = spark, dict(tables), profile, hosts, rates

    @classmethod
    def read(cls, spark: SparkSession, folder: str, *args) -> Engine:
        return cls(spark, {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}, *args)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def _visible(self, source: str | None = None) -> DataFrame:
        return listings.visible(self["opportunities"], "id", self["listings"], self["sources"], self.hosts, self["user_states"], source)

    def _jobs(self, work_mode: str, q: str | None, employment_type: str | None, min_salary: float | None, currency: str) -> DataFrame:
        rows = self._visible().where(F.col("work_mode") == work_mode)
        if q := predicates.optional_filter(q):
            rows = rows.where(predicates.text_search(q, "title", "company", "description"))
        if employment_type := predicates.optional_filter(employment_type):
            rows = rows.where(predicates.employment_type(employment_type))
        return rows if min_salary is None else rows.where(predicates.minimum_salary(min_salary, currency))

    def jobs(self, limit: int = 50, offset: int = 0, work_mode: str = "remote", q: str | None = None, employment_type: str | None = None, min_salary: float | None = None, salary_currency: str = "USD") -> DataFrame:
        rows = self._jobs(work_mode, q, employment_type, min_salary, salary_currency)
        return listings.page_with_links(rows, "recent", limit, offset, self["listings"], self["sources"], self.hosts)

    def count_jobs(self, work_mode: str = "remote", q: str | None = None, employment_type: str | None = None, min_salary: float | None = None, salary_currency: str = "USD") -> DataFrame:
        return self._jobs(work_mode, q, employment_type, min_salary, salary_currency).agg(F.count("*").alias("total"))

    def _matches(self, min_score: int, max_score: int, source: str | None) -> DataFrame:
        scored = self["evaluations"].where((F.col("rules_version") == self.profile.rules_version) & (F.col("profile_id") == self.profile.profile_id))
        scored = scored.where(predicates.score_between(min_score, max_score)).select("opportunity_id", "score")
        return self._visible(source).join(scored, F.col("id") == F.col("opportunity_id")).drop("opportunity_id")

    def matches(self, min_score: int = 55, max_score: int = 100, source: str | None = None, sort: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
        return listings.page_with_links(self._matches(min_score, max_score, source), sort, limit, offset, self["listings"], self["sources"], self.hosts, source)

    def count_matches(self, min_score: int = 55, max_score: int = 100, source: str | None = None) -> DataFrame:
        return self._matches(min_score, max_score, source).agg(F.count("*").alias("total"))

    def sources(self) -> DataFrame:
        return runs.sources_report(self["sources"], self["runs"])

    def stats(self) -> DataFrame:
        return stats.stats(self["opportunities"], self["listings"], self["sources"], self["evaluations"], self["user_states"], self.profile.rules_version, self.profile.threshold)

    def favorites(self) -> DataFrame:
        return stats.favorites(self["user_states"], self["opportunities"], self["listings"], self["sources"], self["evaluations"], self.hosts, self.profile.rules_version)

    def candidates(self, since: datetime) -> DataFrame:
        scored = self["evaluations"].where(F.col("rules_version") == self.profile.rules_version)
        return stats.candidates(scored, self["opportunities"], self["listings"], self["sources"], self["user_states"], self.hosts, self.profile.threshold, since)

    def audit_duplicates(self) -> DataFrame:
        return dedup.audit(self["opportunities"])

    def merges(self) -> DataFrame:
        return dedup.greedy_merges(self["opportunities"].where("kind = 'employment'"), self["listings"], self["sources"])

    def merge_duplicates(self) -> dict[str, DataFrame]:
        """Opportunities (survivors refreshed from their best listing), listings and user states after the merges; write them as a new snapshot."""
        into = stored(self.merges())
        moved = self["listings"].join(into.select(F.col("id").alias("opportunity_id"), "into"), "opportunity_id", "left")
        kept = moved.withColumn("opportunity_id", F.coalesce("into", "opportunity_id")).select(self["listings"].columns)
        left = self["opportunities"].join(into.select("id"), "id", "left_anti")
        grown = into.select(F.col("into").alias("id")).distinct()
        refreshed = listings.refresh_canonical(left.join(grown, "id", "left_semi"), kept, self["sources"]).select(left.columns)
        return {"opportunities": left.join(grown, "id", "left_anti").unionByName(refreshed), "listings": kept, "user_states": dedup.merge_states(self["user_states"], into)}

    def ingest(self, incoming: DataFrame) -> DataFrame:
        return ingest.outcomes(incoming, self["listings"], self["opportunities"])

    def reconcile(self, seen: DataFrame, now: datetime, reason: str = "missing") -> DataFrame:
        return ingest.deactivate_missing(self["listings"], seen, now, reason)

    def expire(self, cutoffs: Mapping[str, datetime]) -> DataFrame:
        return ingest.expire(self["listings"], self["opportunities"], cutoffs)

    def refresh(self) -> DataFrame:
        return listings.refresh_canonical(self["opportunities"], self["listings"], self["sources"])

    def evaluate(self, candidates: DataFrame, force: bool = False) -> DataFrame:
        due = scoring.due_for_evaluation(candidates, self["evaluations"], self.profile.rules_version, force)
        return scoring.score(due, self.profile, self.rates)

    def source_health(self) -> DataFrame:
        return runs.health_events(self["runs"], self["sources"])

    def write(self, folder: str, **tables: DataFrame) -> None:
        """Stores tables as a snapshot in a new folder, never over one that is being read."""
        for name, rows in tables.items():
            rows.write.mode("errorifexists").parquet(f"{folder}/{name}")

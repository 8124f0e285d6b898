"""Readers of what sources publish, and the registry of enabled sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RAW_LISTING = "external_id string, source_url string, payload string, detail_fetched_at timestamp, is_available boolean"


class Source:
    """A named source: how raw listings are read, and how they become normalised rows."""

    def __init__(self, name: str, read: Callable[[SparkSession], DataFrame], normalize: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.name, self.read, self._normalize = name, read, normalize

    def fetch(self, spark: SparkSession) -> DataFrame:
        return self._normalize(self.read(spark))

    def fetch_observed(self, spark: SparkSession, wanted: Column) -> tuple[DataFrame, Observation]:
        """The wanted rows, and the run's counts of candidates and filtered ones, which are there once the rows have been written."""
        seen = Observation(f"{self.name} run")
        rows = self.fetch(spark).withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
        rows = rows.observe(seen, F.count("*").alias("candidates"), F.count_if(~F.col("_wanted")).alias("filtered"))
        return rows.where("_wanted").drop("_wanted"), seen


def static_source(name: str, rows: list[tuple], schema: str = RAW_LISTING) -> Source:
    return Source(name, lambda spark: spark.createDataFrame(rows, schema))


def registry(sources: Iterable[Source], enabled: Iterable[str]) -> list[Source]:
    """The enabled sources in the order in which they are given."""
    wanted = set(enabled)
    return [s for s in sources if s.name in wanted]

"""Registered queries: each a function of (spark, sf_dir), with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacancia.plans.bindings import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name; its SQL may read the bound tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            head, rest = ("WITH RECURSIVE", sql.lstrip()[15:]) if sql.lstrip().upper().startswith("WITH RECURSIVE ") else ("WITH", sql.lstrip()[5:])
            ORACLES[name] = f"{head} {PRELUDE}, {rest}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {PRELUDE} {sql}"
        return f

    return register

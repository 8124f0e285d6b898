"""Registered queries over the engine's operators."""

from vacancia.plans import queries_functions, queries_lifecycle, queries_postings, queries_relational, queries_scoring, queries_sources, queries_upkeep
from vacancia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_functions", "queries_lifecycle", "queries_postings", "queries_relational", "queries_scoring", "queries_sources", "queries_upkeep"]

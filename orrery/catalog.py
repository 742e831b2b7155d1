"""Registered queries."""

from __future__ import annotations

from orrery.plans import admin, kept, knowledge, lists, more, notes, relational, repo, retrieval, states, table_functions  # noqa: F401  they register
from orrery.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "sql_q1_pricing_summary"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

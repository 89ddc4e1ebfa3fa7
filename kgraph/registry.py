"""Query name -> callable, oracle SQL and the IDs of the operators that the query shows."""

from __future__ import annotations

from .plans import graph_queries, lifecycle_queries, session_queries, state_queries, stream_queries, text_queries  # noqa: F401
from .plans.base import OPERATORS, ORACLE_SQL, QUERIES

__all__ = ["OPERATORS", "ORACLE_SQL", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from tidepanel.plans import clean_queries, detect_queries, season_queries, source_queries
from tidepanel.plans.registry import ORACLES, QUERIES

flagship = detect_queries.flagship

__all__ = ["ORACLES", "QUERIES", "clean_queries", "flagship", "season_queries", "source_queries"]

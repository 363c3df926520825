"""Registered queries and their SQL."""

from matchweave.plans import association, dense, features, reports, studies  # noqa: F401  they register themselves
from matchweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

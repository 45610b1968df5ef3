"""Registered queries and the SQL that says the same."""

from tidewire.plans import desk_queries  # noqa: F401  registers its queries
from tidewire.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

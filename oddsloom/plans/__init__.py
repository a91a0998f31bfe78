"""Registered queries, each with the SQL statement that states the same result."""

from .registry import all_oracles, all_queries

__all__ = ["all_queries", "all_oracles"]

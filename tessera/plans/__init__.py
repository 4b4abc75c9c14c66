"""Registered queries and the SQL that says the same."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

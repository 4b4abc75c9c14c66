"""All queries of this package but those of the llm subpackage."""

from __future__ import annotations

from . import graphs, relational, retrieval, streams

_ALL = retrieval.QUERIES | graphs.QUERIES | streams.QUERIES | relational.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

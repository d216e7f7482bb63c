"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations


def _modules():
    from lectern.plans import archives, books, pages, runs, streams, texts

    return (texts, books, pages, archives, runs, streams)


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}

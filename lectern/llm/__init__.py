"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  ``queries`` and
``oracle_sql`` gather what the operator modules register.
"""

from __future__ import annotations


def _modules():
    from lectern.llm import aligned, decontaminate, langid, linededup, mixing, pii, quality, sharding, simhash, tokens, vectors, warc, whiten

    return (langid, pii, quality, decontaminate, linededup, warc, mixing, vectors, simhash, sharding, tokens, whiten, aligned)


def queries() -> dict:
    """Every query of the subpackage, by name."""
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}

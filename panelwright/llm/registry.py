"""Queries of the corpus operators and their SQL checks."""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` with an optional DuckDB check."""

    def wrap(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return wrap

"""Decorator that registers a query with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def named(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return named

    return queries, oracles, query

"""A query is a function (spark, sf_dir) -> DataFrame with a name and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            TWINS[name] = sql
        return f

    return register

"""Registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Adds the decorated (spark, sf_dir) -> DataFrame; sql is its DuckDB equivalent."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add

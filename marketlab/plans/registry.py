"""Registry of queries over the given tables and, where SQL can express them, their DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(ids: str, sql: str | None = None, name: str | None = None):
    """Register `fn(spark, sf_dir)` under its name with the inventory ids it covers."""
    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        SURVEY_IDS[key] = ids
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add

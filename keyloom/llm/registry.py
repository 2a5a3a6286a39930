"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from keyloom.queries.registry import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under ``name``, with an equal SQL query where one exists."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add

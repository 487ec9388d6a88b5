"""The queries that the package registers, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from traceloom.shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), f(spark, sf_dir))[1]
        if sql:
            ORACLES[name] = sql
        return f

    return add

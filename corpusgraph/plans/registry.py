"""Named queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.plans.fixtures import FIXTURE_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = dict(FIXTURE_SQL)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name any fixture view or shared oracle view."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            seen[name] = None


def full_sql(sql: str) -> str:
    """The statement with the views it uses, in dependency order."""
    seen: dict[str, None] = {}
    _needed(sql, seen)
    if not seen:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in seen)
    lead = sql.strip()
    # A statement may go on with views of its own: it then starts with a comma.
    return f"WITH {body}\n{lead}"


def oracle_statements() -> dict[str, str]:
    return {name: full_sql(sql) for name, sql in ORACLE.items()}

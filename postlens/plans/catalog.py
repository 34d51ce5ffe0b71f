"""Registry of runnable queries over the test tables and of the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
STORED: set[str] = set()


def cte(name: str, body: str, stored: bool = False) -> None:
    """A named subquery that oracle texts may refer to; ``stored`` computes it once per statement."""
    CTES[name] = body.strip()
    if stored:
        STORED.add(name)


def expand(select: str) -> str:
    """Puts the named subqueries a statement needs in front of it."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    recursive = "RECURSIVE " if any(n.startswith("reach") for n in needed) else ""
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTES[n]})" for n in needed)
    return f"WITH {recursive}{parts}\n{select.strip()}"


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say it, its oracle."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return register

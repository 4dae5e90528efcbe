"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from credalis.plans.views import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """Prefix a SQL body with the named views, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    body = body.strip()
    joined = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {joined},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] | str = ()):
    """Register ``fn(tables)`` under ``name`` with its oracle SQL."""
    ctes = (ctes,) if isinstance(ctes, str) else ctes

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql)
        return fn

    return add

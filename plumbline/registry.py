"""Catalog of runnable queries, each with the SQL text that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


CATALOG: dict[str, Query] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    """Register the SQL text of a derived input that several queries share."""
    VIEWS[name] = (uses, sql.strip())


def _with_clause(uses: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in VIEWS[name][0]:
            visit(dependency)
        ordered.append(name)

    for name in uses:
        visit(name)
    return ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] | str = ()) -> Callable[[Build], Build]:
    """Register a query; `uses` names the derived inputs its SQL text selects from."""
    names = (uses,) if isinstance(uses, str) else tuple(uses)

    def register(build: Build) -> Build:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        text = None
        if sql is not None:
            body = sql.strip()
            clause = _with_clause(names)
            if not clause:
                text = body
            elif body.upper().startswith("WITH RECURSIVE"):
                text = f"WITH RECURSIVE {clause},\n{body[14:].lstrip()}"
            elif body.upper().startswith("WITH "):
                text = f"WITH {clause},\n{body[5:]}"
            else:
                text = f"WITH {clause}\n{body}"
        CATALOG[name] = Query(name, build, text)
        return build

    return register


def sql_text(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    """Python strings as a parenthesised SQL list."""
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"

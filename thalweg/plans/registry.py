"""Registry that keeps each query beside the SQL it is checked against."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import DUCK, VIEWS, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the input views by name."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


def with_views(sql: str) -> str:
    """SQL text preceded by the input views that it needs, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{name} AS ({render(VIEWS[name], DUCK)})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[len('WITH '):]}"
    return f"WITH {heads}\n{body}"


def growth_sql(value: str, coefficients) -> str:
    """The growth expression as SQL text."""
    total = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = f"({total} * ({value}) + CAST({c!r} AS DOUBLE))"
    return f"CASE WHEN {value} > 25 THEN CAST(-15 AS DOUBLE) ELSE 1000 * {total} END"

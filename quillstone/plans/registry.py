"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

_queries: dict[str, Callable[..., DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("sources", "search", "indexes", "conversion", "parts", "catalog", "merges", "texts", "pages", "records", "results", "lifecycle", "streams")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillstone.plans.{m}")


def queries() -> dict[str, Callable[..., DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)

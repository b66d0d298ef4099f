"""Registry of the library's queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("scoring", "evaluation", "sampling", "splits", "graphs", "text", "relational", "reports", "learning", "filters", "audits", "trips")


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def register(name: str, f, sql: str | None = None) -> None:
    _QUERIES[name] = f
    if sql:
        _SQL[name] = sql.strip()


def _load() -> None:
    for m in MODULES:
        import_module(f"pairwright.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["language_breakdown"](spark, sf_dir)

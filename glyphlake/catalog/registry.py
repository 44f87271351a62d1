"""Query registry: a Spark function and, where SQL can say it, a check in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.catalog import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_SECTIONS = ("expressions", "lookups", "setqueries", "jobs", "tables", "records", "sequences", "geometries", "pages", "corpora", "streams")


def query(name: str, sql: str | None = None, recursive: bool = False, paged: bool = False):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the views of ``views``. ``paged``: glyphs stay with their page."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn((views.PagedTables if paged else views.Tables)(spark, sf_dir))

        run.__doc__ = fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = views.with_views(sql, recursive)
        return fn

    return register


def load_all() -> None:
    for section in _SECTIONS:
        importlib.import_module(f"glyphlake.catalog.{section}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_SQL)

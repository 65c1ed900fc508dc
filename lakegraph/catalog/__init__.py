"""Every operator applied to the benchmark tables, with the SQL that gives the same answer.

The tables hold no movies, so titles, people and ratings are views of orders, customers,
line items and events. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = use_utc(spark), folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    """Register ``function(tables)`` under its name, with its SQL twin if there is one."""

    def register(function):
        name = function.__name__
        _QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from . import embedding, formatting, graph, quality, relational, series, storage, whole  # noqa: F401

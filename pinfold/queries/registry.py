"""All queries of the core by name, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Makes a function (session, data folder) -> DataFrame a named query, with SQL that gives the same rows if there is any."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} exists")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    import pinfold.queries as here

    for m in pkgutil.iter_modules(here.__path__):
        importlib.import_module(f"pinfold.queries.{m.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return queries()["search_batch"](spark, sf)

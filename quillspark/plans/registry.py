"""Where queries register themselves by name, each with SQL for an independent engine if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.fixtures import Fixtures, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Fixtures], DataFrame]], Query]:
    """Register a query over fixtures; ``sql`` may use the fixture views by name."""

    def wrap(f: Callable[[Fixtures], DataFrame]) -> Query:
        query = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = with_views(sql)
        return query

    return wrap


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

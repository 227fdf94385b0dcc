"""Registered queries: Spark plan plus, where SQL can say it, the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Roles, with_views

Builder = Callable[[Roles], DataFrame]

_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = build
        if sql is not None:
            _SQL[key] = with_views(sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Roles(spark, sf_dir))

    return {key: bind(build) for key, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

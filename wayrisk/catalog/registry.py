"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayrisk.catalog.ctes import with_ctes
from wayrisk.catalog.views import Views, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the twin's body over the shared CTEs."""

    def add(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: tidy(build(Views(spark, folder)))
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return build

    return add


def r6(*names: str) -> str:
    """``round(x, 6) AS x`` for each name."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def load() -> None:
    from wayrisk.catalog import (  # noqa: F401
        compare_queries,
        exposure_queries,
        forecast_queries,
        ingest_queries,
        report_queries,
        scorecard_queries,
        storage_queries,
        usage_queries,
    )

"""Named queries over the shared tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.driver_tables import ANNOTATIONS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str | None = ANNOTATIONS_SQL):
    """Register a query. ``views`` is prepended to ``sql`` as common table expressions."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            text = sql.strip()
            if views is not None:
                joiner = ",\n" if text.startswith(",") else "\n"
                text = f"WITH {views}{joiner}{text.lstrip(',').lstrip()}"
            ORACLES[name] = text
        return function

    return register

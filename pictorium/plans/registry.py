"""All catalogue queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its name; `views` are the definitions that its SQL builds on."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return function

    return add


# the modules below register their queries here
from pictorium.plans import boxes, curation, identity, ingest, pictures, relational, training  # noqa: E402, F401

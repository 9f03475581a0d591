"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a function under its name; ``ctes`` are put before ``sql``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if ctes:
                more = text[4:].lstrip() if text.lower().startswith("with") else None
                text = "with " + ",\n".join(c.strip() for c in ctes) + (",\n" + more if more else "\n" + text)
            SQL[f.__name__] = text
        return f

    return add

"""Registered queries: each operator run over the given tables, with an oracle.

``REGISTRY`` maps a name to the Spark query and to SQL that DuckDB runs on the
same tables, or None where SQL cannot say it. Instants and days are rendered as
text so that both sides compare without time zones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register under ``name``, by default the function's own."""

    def register(function: Query) -> Query:
        REGISTRY[name or function.__name__] = (function, oracle)
        return function

    return register

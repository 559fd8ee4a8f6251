"""Evaluating dear expressions once.

Catalyst copies an expression to every place that refers to it, and pushes
filters on it below the projection that computes it. That is right for cheap
expressions, but parsing a document again for each test on it is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, where ``value`` is bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(
    df: DataFrame, name: str, value: Column, keep: list[str] | None = None
) -> DataFrame:
    """Add a column that later filters and projections read, not recompute.

    A one-element array is exploded, because filters on generated columns stay
    above the generator.
    """
    keep = df.columns if keep is None else keep
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def with_once_where(
    df: DataFrame, name: str, value: Column, condition: Callable[[Column], Column]
) -> DataFrame:
    """Like :func:`with_once`, keeping only rows whose value fulfils ``condition``."""
    return df.select("*", F.explode(F.filter(F.array(value), condition)).alias(name))

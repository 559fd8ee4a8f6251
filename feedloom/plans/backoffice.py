"""Back office: the editor's list and a record's details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.display import fmt_day
from feedloom.operators.serve import admin_rows, get_article, get_stored, listing


def editor_list(news: DataFrame, lang: str) -> DataFrame:
    return admin_rows(listing(news), lang, keep=["id"])


def record(news: DataFrame, id: str, lang: str) -> DataFrame:
    """All fields of a row, with its date in words."""
    return get_article(news, id).withColumn("date", fmt_day(F.col("published_at"), lang))


def stored_record(spark: SparkSession, path: str, id: str, lang: str) -> DataFrame:
    """:func:`record` of the table at ``path``; only the days that its keys name are read."""
    return get_stored(spark, path, id).withColumn("date", fmt_day(F.col("published_at"), lang))

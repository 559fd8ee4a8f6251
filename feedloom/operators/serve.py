"""Reads of the portal and the back office."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import Instant, day_key, days_ago
from feedloom.functions.display import fmt_numeric, language
from feedloom.functions.fixed import LATEST_ARTICLES, STATUS_LABEL
from feedloom.sources.news import news_of


def newest_first(ts: str = "published_at", tie: str = "id") -> list[Column]:
    """Descending time with undated rows in front, then ascending ``tie``."""
    return [F.desc_nulls_first(ts), F.asc(tie)]


# Reaches back this many days, one after the other, for the newest rows.
_LOOK_BACK = (1, 7, 31, 366)


def latest(
    news: DataFrame,
    n: int = LATEST_ARTICLES,
    ts: str = "published_at",
    now: Instant | None = None,
) -> DataFrame:
    """The newest ``n`` rows; each task keeps ``n`` and nothing is sorted in full.

    With ``now``, the stored table is only read as far back as needed: the folders of
    the last day, week, month or year are used if they are counted to hold ``n``
    rows, and all of them otherwise. The result is the same. Folders are days of
    ``published_at``, so they say nothing about any other ``ts``.
    """
    if now is not None and ts == "published_at" and "published_date" in news.columns:
        for days in _LOOK_BACK:
            first = day_key(days_ago(now, days))
            undated = F.col("published_date").isNull()
            part = news.where(undated | (F.col("published_date") >= first))
            if part.limit(n).count() == n:
                news = part
                break
    return news.orderBy(*newest_first(ts)).limit(n)


def listing(news: DataFrame, ts: str = "published_at") -> DataFrame:
    """All rows, newest first. Its count is :func:`feedloom.operators.metrics.total`."""
    return news.orderBy(*newest_first(ts))


def oldest_first(news: DataFrame, ts: str = "published_at") -> DataFrame:
    """Ascending scan, for rows that were filtered by time."""
    return news.orderBy(F.asc_nulls_last(ts), F.asc("id"))


def get_article(news: DataFrame, id: str) -> DataFrame:
    """The row with this id. No row, or more than one, gives an empty result."""
    row = F.any_value(F.struct(*news.columns)).alias("row")
    return (
        news.where(F.col("id") == id)
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), row)
        .where(F.col("n") == 1)
        .select("row.*")
    )


def get_stored(spark: SparkSession, path: str, id: str) -> DataFrame:
    """:func:`get_article` of a stored table; only the days that its keys name are read."""
    wanted = spark.createDataFrame([(id,)], "id string")
    return get_article(news_of(spark, path, wanted), id)


def localize(news: DataFrame, lang: str) -> DataFrame:
    """Add ``title`` and ``summary`` in the chosen language, without fallback."""
    suffix = language(lang)
    return news.withColumns(
        {"title": F.col(f"title_{suffix}"), "summary": F.col(f"summary_{suffix}")}
    )


def admin_rows(news: DataFrame, lang: str, keep: list[str] | None = None) -> DataFrame:
    """Date, category, English title and status for the back office."""
    return news.select(
        *(keep or []),
        fmt_numeric(F.col("published_at"), lang).alias("date"),
        "category",
        "title_en",
        F.lit(STATUS_LABEL[language(lang)]).alias("status"),
    )

"""Portal: the front page and an article's page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import Instant
from feedloom.functions.display import fmt_long, fmt_short
from feedloom.operators.serve import get_article, get_stored, latest, localize


def _page(articles: DataFrame, lang: str, text_of) -> DataFrame:
    return localize(articles, lang).select(
        "id",
        "category",
        "source_name",
        "source_url",
        "published_at",
        text_of(F.col("published_at"), lang).alias("date"),
        "title",
        "summary",
    )


def front_page(news: DataFrame, lang: str, now: Instant | None = None) -> DataFrame:
    """The newest articles; ``now`` saves reading old days of the stored table."""
    return _page(latest(news, now=now), lang, fmt_short)


def article_page(news: DataFrame, id: str, lang: str) -> DataFrame:
    """One row, or none when there is no such article."""
    return _page(get_article(news, id), lang, fmt_long)


def stored_article_page(spark: SparkSession, path: str, id: str, lang: str) -> DataFrame:
    """:func:`article_page` of the table at ``path``; only the days that its keys name are read."""
    return _page(get_stored(spark, path, id), lang, fmt_long)

"""From entries to article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions.dates import Instant, like, recent_cutoff
from feedloom.functions.fixed import ARTICLES_PER_FEED, RECENT_HOURS, UNKNOWN_SOURCE
from feedloom.functions.response import field_or, has_answer


def recent(df: DataFrame, ts: str, now: Instant, hours: int = RECENT_HOURS) -> DataFrame:
    """Rows at or after ``now - hours``; there is no upper bound."""
    return df.where(F.col(ts) >= like(df, ts, recent_cutoff(now, hours)))


def content(summary: Column, title: Column) -> Column:
    """The summary if there is one, even an empty one; else the title."""
    return F.coalesce(summary, title)


def source_name(feed_title: Column) -> Column:
    return F.coalesce(feed_title, F.lit(UNKNOWN_SOURCE))


def enriched_only(df: DataFrame, answer: str = "answer") -> DataFrame:
    return df.where(has_answer(F.col(answer)))


def to_article(df: DataFrame, answer: str = "answer", keep: list[str] | None = None) -> DataFrame:
    """Article records from entries (``category, feed_title, link, title``) with answers."""
    a = F.col(answer)
    return df.select(
        *(keep or []),
        "category",
        source_name(F.col("feed_title")).alias("source_name"),
        F.col("link").alias("source_url"),
        field_or(a, "title_en", F.col("title")).alias("title_en"),
        field_or(a, "title_pt", F.lit("")).alias("title_pt"),
        field_or(a, "summary_en", F.lit("")).alias("summary_en"),
        field_or(a, "summary_pt", F.lit("")).alias("summary_pt"),
    )


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``.

    Spark limits each group to ``n`` rows before the shuffle as well
    (``WindowGroupLimit``), so a group of any size sends at most ``n`` rows per
    map task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def cap_per_feed(
    df: DataFrame,
    feed: tuple[str, ...] = ("category", "feed_url"),
    order: tuple[str, ...] = ("pos",),
    n: int = ARTICLES_PER_FEED,
) -> DataFrame:
    """The first ``n`` rows of each feed in feed order.

    Apply it to recent rows that have an answer: failures do not use the quota.
    """
    return first_rows(df, list(feed), list(order), n)


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; unlike ``dropDuplicates`` not just any row."""
    return first_rows(df, [key], order, 1)


def harvest_report(
    articles: DataFrame, by: tuple[str, str] = ("category", "feed_url")
) -> DataFrame:
    """Articles kept per feed, per category and in all.

    ``level`` is 0 for a feed, 1 for a category and 3 for the total. Rows are
    counted per feed before the roll-up multiplies them.
    """
    per_feed = articles.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return per_feed.rollup(*by).agg(
        F.grouping_id(*by).cast("bigint").alias("level"), F.sum("n").alias("articles")
    )

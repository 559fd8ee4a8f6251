"""Counts for the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import Instant, day_key, day_spine, days_ago, like, midnight
from feedloom.functions.display import weekday
from feedloom.functions.fixed import DASHBOARD_DAYS, OTHER_CATEGORY


def since(df: DataFrame, bound: Column, ts: str = "published_at") -> DataFrame:
    """Rows at or after ``bound``; rows without a time are out.

    In the stored table the bound also skips the folders of earlier days.
    """
    if ts == "published_at" and "published_date" in df.columns:
        df = df.where(F.col("published_date") >= day_key(bound))
    return df.where(F.col(ts) >= like(df, ts, bound))


def category_or_other(category: Column) -> Column:
    """``Other`` for a missing or empty category."""
    return F.coalesce(F.nullif(category, F.lit("")), F.lit(OTHER_CATEGORY))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, a missing one included."""
    return df.select(column).distinct()


def total(news: DataFrame) -> DataFrame:
    return news.agg(F.count(F.lit(1)).alias("total"))


def week_total(news: DataFrame, now: Instant, ts: str = "published_at") -> DataFrame:
    """Rows of the last seven times 24 hours. Only those are read."""
    return since(news, days_ago(now, DASHBOARD_DAYS), ts).agg(F.count(F.lit(1)).alias("week_total"))


def today_total(
    news: DataFrame, now: Instant, tz: str = "UTC", ts: str = "published_at"
) -> DataFrame:
    """Rows since midnight in ``tz``."""
    return since(news, midnight(now, tz), ts).agg(F.count(F.lit(1)).alias("today_total"))


def source_count(source: str = "source_name", approximate: bool = False) -> Column:
    """Number of distinct sources; case matters and a missing one counts as one."""
    missing = F.max(F.when(F.col(source).isNull(), 1).otherwise(0))
    distinct = F.approx_count_distinct(source) if approximate else F.count_distinct(source)
    return distinct + F.coalesce(missing, F.lit(0))


def active_sources(news: DataFrame, source: str = "source_name") -> DataFrame:
    return news.agg(source_count(source).alias("active_sources"))


# A sketch of 2**12 counters is off by 1.04 / 2**6 of the count at one standard deviation.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def source_sketches(news: DataFrame, ts: str = "published_at", source: str = "source_name") -> DataFrame:
    """One row per UTC day: a sketch of its distinct sources, and whether one is missing.

    Opt-in, for tables whose exact count of sources is too dear to refresh: a day that is past
    is sketched once, and the sketches of any days are merged by `sources_of_sketches`.
    Rows without a time have a day of their own, NULL.
    """
    return news.groupBy(day_key(F.col(ts)).alias("day")).agg(
        F.hll_sketch_agg(source, SKETCH_BITS).alias("sketch"),
        F.coalesce(F.max(F.col(source).isNull()), F.lit(False)).alias("missing"),
    )


def sources_of_sketches(sketches: DataFrame) -> DataFrame:
    """About how many distinct sources the days of these sketches have: ``active_sources``.

    An estimate, by `SKETCH_ERROR` off at one standard deviation; :func:`active_sources` is
    exact. A missing source counts as one.
    """
    merged = sketches.agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"), F.max(F.col("missing").cast("int")).alias("missing")
    )
    return merged.select((F.coalesce("n", F.lit(0)) + F.coalesce("missing", F.lit(0))).alias("active_sources"))


def kpis(
    news: DataFrame,
    now: Instant,
    tz: str = "UTC",
    ts: str = "published_at",
    source: str = "source_name",
    approximate: bool = False,
) -> DataFrame:
    """All scalar counts in one pass over two columns."""

    def at_or_after(bound: Column) -> Column:
        return F.count_if(F.col(ts) >= like(news, ts, bound))

    return news.agg(
        F.count(F.lit(1)).alias("total"),
        at_or_after(days_ago(now, DASHBOARD_DAYS)).alias("week_total"),
        at_or_after(midnight(now, tz)).alias("today_total"),
        source_count(source, approximate).alias("active_sources"),
    )


def _spine_bounds(now: Instant) -> tuple[Column, Column]:
    """First day of the spine and the day after its last."""
    days = day_spine(now, DASHBOARD_DAYS)
    return F.element_at(days, 1), F.date_add(F.element_at(days, -1), 1)


def fill_days(counts: DataFrame, now: Instant, lang: str = "en") -> DataFrame:
    """Counts ``(day, n)`` put on the seven UTC days that end today, zero-filled."""
    first, end = _spine_bounds(now)
    # One row per day of the spine at most, hence the broadcast.
    on_spine = (
        counts.where((F.col("day") >= first) & (F.col("day") < end))
        .groupBy("day")
        .agg(F.sum("n").alias("n"))
    )
    spine = counts.sparkSession.range(1, numPartitions=1).select(
        F.explode(day_spine(now, DASHBOARD_DAYS)).alias("day")
    )
    return (
        spine.join(F.broadcast(on_spine), "day", "left")
        .select(
            "day",
            weekday(F.col("day"), lang).alias("name"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("day")
    )


def daily_volume(
    news: DataFrame, now: Instant, lang: str = "en", ts: str = "published_at"
) -> DataFrame:
    """Rows per day for the seven UTC days that end today, empty days included.

    Columns ``day``, ``name`` (weekday), ``count``. The first day starts after
    ``now`` minus seven days, so the counts may add up to less than
    :func:`week_total`. Days after today are ignored.
    """
    first, end = _spine_bounds(now)
    # Bounds on the timestamp itself, so that they reach the scan.
    counts = (
        since(news, first, ts)
        .where(F.col(ts) < like(news, ts, end))
        .groupBy(day_key(F.col(ts)).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return fill_days(counts, now, lang)


def category_counts(news: DataFrame, category: str = "category") -> DataFrame:
    return news.groupBy(category_or_other(F.col(category)).alias("name")).agg(
        F.count(F.lit(1)).alias("value")
    )


def category_distribution(news: DataFrame, category: str = "category") -> DataFrame:
    """Rows per category, most frequent first, then by name."""
    return category_counts(news, category).orderBy(F.desc("value"), "name")


def category_share(news: DataFrame, category: str = "category") -> DataFrame:
    """Categories with their part of all rows."""
    counts = category_counts(news, category)
    everything = counts.agg(F.sum("value")).scalar()
    return counts.withColumn("share", F.col("value") / everything).orderBy(F.desc("value"), "name")

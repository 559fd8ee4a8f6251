"""Dashboard, portal and back office."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions.dates import day_key, days_ago, instant, latest_instant
from feedloom.functions.display import fmt_day, fmt_int, fmt_long, fmt_numeric, fmt_short, weekday
from feedloom.operators.metrics import (
    SKETCH_ERROR,
    active_sources,
    category_distribution,
    category_share,
    daily_volume,
    distinct_values,
    kpis,
    since,
    source_sketches,
    sources_of_sketches,
    today_total,
    total,
    week_total,
)
from feedloom.operators.serve import admin_rows, latest, newest_first, oldest_first
from feedloom.operators.skew import ranked
from feedloom.plans.backoffice import editor_list, record, stored_record
from feedloom.plans.dashboard import dashboard
from feedloom.plans.portal import article_page, front_page, stored_article_page
from feedloom.session import materialize, scratch_path
from feedloom.sources.news import append_news, read_news
from queries import query
from queries.inputs import SQL_NEWS, SQL_STAMP, news_view, stamp, table

_SQL_NOW = "(SELECT max(ts) FROM events)"


def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events, latest_instant(events, "ts")


@query(
    f"""
    SELECT count(*) AS total,
           count_if(ts >= {_SQL_NOW} - INTERVAL 168 HOUR)::BIGINT AS week_total,
           count_if(ts >= date_trunc('day', {_SQL_NOW}))::BIGINT AS today_total,
           count(DISTINCT event_type) AS active_sources
    FROM events
    """
)
def kpi_row(spark, sf_dir):
    events, now = _events(spark, sf_dir)
    return kpis(events, now, ts="ts", source="event_type")


@query(
    f"""
    SELECT (SELECT count(*) FROM events) AS total,
           (SELECT count(*) FROM events WHERE ts >= {_SQL_NOW} - INTERVAL 168 HOUR) AS week_total,
           (SELECT count(*) FROM events
            WHERE ts >= date_trunc('day', {_SQL_NOW} - INTERVAL 3 HOUR) + INTERVAL 3 HOUR)
               AS today_total
    """
)
def separate_counts(spark, sf_dir):
    """The counts as queries of their own; today is a day in São Paulo (UTC-3)."""
    events, now = _events(spark, sf_dir)
    # One row each.
    return spark.range(1).select(
        total(events).scalar().alias("total"),
        week_total(events, now, "ts").scalar().alias("week_total"),
        today_total(events, now, "America/Sao_Paulo", "ts").scalar().alias("today_total"),
    )


@query(
    f"""
    SELECT count(DISTINCT source_name) + max(CASE WHEN source_name IS NULL THEN 1 ELSE 0 END)
               AS active_sources
    FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN source_name END AS source_name FROM ({SQL_NEWS}))
    """
)
def active_sources_null(spark, sf_dir):
    source = F.when(F.col("doc_id") % 9 != 0, F.col("source_name"))
    return active_sources(news_view(spark, sf_dir).withColumn("source_name", source))


@query(
    f"""
    SELECT DISTINCT CASE WHEN doc_id % 9 <> 0 THEN source_name END AS source_name FROM ({SQL_NEWS})
    """
)
def distinct_sources(spark, sf_dir):
    source = F.when(F.col("doc_id") % 9 != 0, F.col("source_name"))
    return distinct_values(news_view(spark, sf_dir).withColumn("source_name", source), "source_name")


def _sql_daily(rows: str, ts: str, names: str) -> str:
    return f"""
    WITH days AS (
        SELECT CAST(CAST({_SQL_NOW} AS DATE) - i AS DATE) AS day
        FROM (SELECT CAST(unnest(generate_series(0, 6)) AS INTEGER) AS i)
    ), counts AS (
        SELECT CAST({ts} AS DATE) AS day, count(*) AS n FROM {rows}
        WHERE {ts} >= {_SQL_NOW} - INTERVAL 168 HOUR GROUP BY 1
    )
    SELECT CAST(days.day AS VARCHAR) AS day, {names}[dayofweek(days.day) + 1] AS name,
           coalesce(counts.n, 0) AS count
    FROM days LEFT JOIN counts ON counts.day = days.day
    """


@query(_sql_daily("events", "ts", "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']"), name="daily_volume")
def daily_bars(spark, sf_dir):
    events, now = _events(spark, sf_dir)
    return daily_volume(events, now, ts="ts").withColumn("day", F.col("day").cast("string"))


@query(
    _sql_daily(
        f"({SQL_NEWS})", "published_at", "['Dom', 'Seg', 'Ter', 'Qua', 'Qui', 'Sex', 'Sab']"
    ),
    name="daily_volume_sparse",
)
def daily_bars_sparse(spark, sf_dir):
    """Documents cover the first days of the month only, so most bars are zero."""
    _, now = _events(spark, sf_dir)
    bars = daily_volume(news_view(spark, sf_dir), now, "pt")
    return bars.withColumn("day", F.col("day").cast("string"))


_SQL_CATEGORIES = """
    SELECT coalesce(nullif(CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ''
                                ELSE event_type END, ''), 'Other') AS name, count(*) AS value
    FROM events GROUP BY 1
"""


def _categorized(spark, sf_dir):
    form = F.col("event_id") % 10
    category = F.when(form == 1, "").when(form != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("category", category)


@query(
    f"""
    SELECT name, value, row_number() OVER (ORDER BY value DESC, name) AS rank
    FROM ({_SQL_CATEGORIES})
    """,
    name="category_distribution",
)
def category_counts_ranked(spark, sf_dir):
    counts = category_distribution(_categorized(spark, sf_dir))
    return ranked(counts, [F.desc("value"), F.asc("name")])


@query(f"SELECT name, value, value / sum(value) OVER () AS share FROM ({_SQL_CATEGORIES})", name="category_share")
def category_shares(spark, sf_dir):
    return category_share(_categorized(spark, sf_dir))


def _undated(spark, sf_dir):
    """News of which some have no date."""
    dated = F.when(F.col("doc_id") % 17 != 0, F.col("published_at"))
    return news_view(spark, sf_dir).withColumn("published_at", dated)


_SQL_UNDATED = f"""
    SELECT * REPLACE (CASE WHEN doc_id % 17 <> 0 THEN published_at END AS published_at)
    FROM ({SQL_NEWS})
"""
_SQL_MONTHS_SHORT = (
    "['jan.', 'fev.', 'mar.', 'abr.', 'mai.', 'jun.', "
    "'jul.', 'ago.', 'set.', 'out.', 'nov.', 'dez.']"
)
_SQL_MONTHS_LONG = (
    "['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', "
    "'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro']"
)


def _sql_day_pt(ts: str, months: str) -> str:
    return f"strftime({ts}, '%d') || ' de ' || {months}[month({ts})] || ' de ' || strftime({ts}, '%Y')"


@query(
    f"""
    SELECT row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS rank, id, category,
           source_name, {_sql_day_pt('published_at', _SQL_MONTHS_SHORT)} AS date,
           title_pt AS title, summary_pt AS summary
    FROM ({_SQL_UNDATED}) ORDER BY rank LIMIT 20
    """
)
def latest_20(spark, sf_dir):
    # At most 20 rows are left to number.
    rank = F.row_number().over(Window.orderBy(*newest_first())).cast("bigint")
    page = front_page(_undated(spark, sf_dir), "pt").withColumn("rank", rank)
    return page.select("rank", "id", "category", "source_name", "date", "title", "summary")


@query(
    f"""
    SELECT id, category, source_name, source_url,
           strftime(published_at, '%B %d, %Y at %I:%M %p') AS date,
           title_en AS title, summary_en AS summary
    FROM ({SQL_NEWS}) WHERE id = '42'
    """
)
def article_by_id(spark, sf_dir):
    return article_page(news_view(spark, sf_dir), "42", "en").drop("published_at")


@query(
    f"""
    SELECT id, source_url, {_sql_day_pt('published_at', _SQL_MONTHS_LONG)} AS date, title_en
    FROM ({SQL_NEWS}) WHERE id = '7'
    """
)
def record_by_id(spark, sf_dir):
    return record(news_view(spark, sf_dir), "7", "pt").select("id", "source_url", "date", "title_en")


@query(
    f"""
    SELECT row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS rank, id,
           strftime(published_at, '%-m/%-d/%Y') AS date, category, title_en, 'Published' AS status
    FROM ({_SQL_UNDATED})
    """
)
def listing_ranked(spark, sf_dir):
    rows = admin_rows(_undated(spark, sf_dir), "en", keep=["id", "published_at"])
    return ranked(rows, newest_first()).drop("published_at")


@query(
    f"""
    SELECT row_number() OVER (ORDER BY ts, event_id) AS rank, event_id,
           strftime(ts, {SQL_STAMP}) AS ts
    FROM events WHERE ts >= {_SQL_NOW} - INTERVAL 168 HOUR
    """
)
def window_scan_asc(spark, sf_dir):
    events, now = _events(spark, sf_dir)
    week = since(events, days_ago(now, 7), "ts").select("event_id", "ts")
    scan = ranked(week, [F.asc_nulls_last("ts"), F.asc("event_id")])
    return scan.select("rank", "event_id", stamp("ts").alias("ts"))


@query(
    f"""
    SELECT event_id, strftime(ts, '%b %d, %Y') AS short_en,
           {_sql_day_pt('ts', _SQL_MONTHS_SHORT)} AS short_pt,
           strftime(ts, '%B %d, %Y at %I:%M %p') AS long_en,
           {_sql_day_pt('ts', _SQL_MONTHS_LONG)} || ' às ' || strftime(ts, '%H:%M') AS long_pt,
           strftime(ts, '%B %d, %Y') AS day_en, {_sql_day_pt('ts', _SQL_MONTHS_LONG)} AS day_pt,
           strftime(ts, '%-m/%-d/%Y') AS numeric_en, strftime(ts, '%d/%m/%Y') AS numeric_pt,
           ['Dom', 'Seg', 'Ter', 'Qua', 'Qui', 'Sex', 'Sab'][dayofweek(ts) + 1] AS weekday_pt,
           format('{{:,}}', coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id * 1000 END, 0)) AS count
    FROM events
    """
)
def format_dates(spark, sf_dir):
    ts = F.col("ts")
    count = F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 1000)
    return table(spark, sf_dir, "events").select(
        "event_id",
        fmt_short(ts, "en").alias("short_en"),
        fmt_short(ts, "pt").alias("short_pt"),
        fmt_long(ts, "en").alias("long_en"),
        fmt_long(ts, "pt").alias("long_pt"),
        fmt_day(ts, "en").alias("day_en"),
        fmt_day(ts, "pt").alias("day_pt"),
        fmt_numeric(ts, "en").alias("numeric_en"),
        fmt_numeric(ts, "pt").alias("numeric_pt"),
        weekday(F.to_date(ts), "pt").alias("weekday_pt"),
        fmt_int(count).alias("count"),
    )


@query(
    f"""
    WITH news AS ({SQL_NEWS}), categories AS (
        SELECT coalesce(nullif(category, ''), 'Other') AS name, count(*) AS n FROM news GROUP BY 1
    ), daily AS ({_sql_daily(f"({SQL_NEWS})", "published_at", "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']")})
    SELECT 'kpi' AS kind, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM news
    UNION ALL SELECT 'kpi', 'week_total', count_if(published_at >= {_SQL_NOW} - INTERVAL 168 HOUR) FROM news
    UNION ALL SELECT 'kpi', 'today_total', count_if(published_at >= date_trunc('day', {_SQL_NOW})) FROM news
    UNION ALL SELECT 'kpi', 'active_sources', count(DISTINCT source_name) FROM news
    UNION ALL SELECT 'day', day || ' ' || name, count FROM daily
    UNION ALL SELECT 'category', name, n FROM categories
    UNION ALL SELECT 'share', name, n / sum(n) OVER () FROM categories
    """,
    name="dashboard",
)
def dashboard_run(spark, sf_dir):
    """The dashboard's three tables as one."""
    _, now = _events(spark, sf_dir)
    parts = dashboard(news_view(spark, sf_dir), now)

    def rows(df, kind, name, value):
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))

    kpi = parts["kpis"].unpivot([], ["total", "week_total", "today_total", "active_sources"], "name", "value")
    day = F.concat_ws(" ", F.col("day").cast("string"), "name")
    return (
        rows(kpi, "kpi", F.col("name"), F.col("value"))
        .unionByName(rows(parts["daily"], "day", day, F.col("count")))
        .unionByName(rows(parts["categories"], "category", F.col("name"), F.col("value")))
        .unionByName(rows(parts["categories"], "share", F.col("name"), F.col("share")))
    )


@query(
    f"""
    SELECT id, strftime(published_at, '%d/%m/%Y') AS date, category, title_en, 'Publicado' AS status
    FROM ({_SQL_UNDATED})
    """,
    name="editor_list",
)
def editors_rows(spark, sf_dir):
    return editor_list(_undated(spark, sf_dir), "pt")


@query(f"SELECT id, strftime(published_at, {SQL_STAMP}) AS published_at FROM ({_SQL_UNDATED})", name="oldest_first")
def oldest_rows(spark, sf_dir):
    ordered = oldest_first(_undated(spark, sf_dir).select("id", "published_at"))
    return ordered.select("id", stamp("published_at").alias("published_at"))


@query(
    f"""
    WITH stored AS (SELECT id, published_at, published_at - to_days(CAST(doc_id % 40 AS INT)) AS entry FROM ({SQL_NEWS})
                    WHERE published_at IS NOT NULL)
    SELECT * FROM (SELECT 'inserted' AS by_time, id FROM stored ORDER BY published_at DESC, id LIMIT 20)
    UNION ALL
    SELECT * FROM (SELECT 'entry', id FROM stored ORDER BY entry DESC, id LIMIT 20)
    """
)
def latest_stored(spark, sf_dir):
    """The newest rows of a stored table, by the time of insertion and by that of the entry."""
    _, now = _events(spark, sf_dir)
    path = scratch_path(spark, "latest-news")
    age = F.make_interval(days=(F.col("doc_id") % 40).cast("int"))
    append_news(news_view(spark, sf_dir).withColumn("entry_published_at", F.col("published_at") - age), path)
    news = read_news(spark, path)
    inserted = latest(news, now=now).select(F.lit("inserted").alias("by_time"), "id")
    entry = latest(news, ts="entry_published_at", now=now).select(F.lit("entry").alias("by_time"), "id")
    return inserted.unionByName(entry)


@query(
    f"""
    SELECT 'page' AS kind, id, source_url, strftime(published_at, '%B %d, %Y at %I:%M %p') AS date, title_en AS title
    FROM ({SQL_NEWS}) WHERE id = '42'
    UNION ALL
    SELECT 'record', id, source_url, {_sql_day_pt('published_at', _SQL_MONTHS_LONG)}, title_en
    FROM ({SQL_NEWS}) WHERE id = '7'
    """
)
def article_stored(spark, sf_dir):
    """Pages of single articles of a stored table, found by its keys."""
    path = scratch_path(spark, "paged-news")
    append_news(news_view(spark, sf_dir).withColumn("entry_published_at", F.lit(None).cast("timestamp")), path)
    page, details = stored_article_page(spark, path, "42", "en"), stored_record(spark, path, "7", "pt")
    return page.select(F.lit("page").alias("kind"), "id", "source_url", "date", "title").unionByName(
        details.select(F.lit("record").alias("kind"), "id", "source_url", "date", F.col("title_en").alias("title"))
    )


@query(
    f"""
    SELECT 'all days' AS days, count(DISTINCT user_id) AS exact, true AS near FROM events
    UNION ALL
    SELECT 'week', count(DISTINCT user_id), true FROM events WHERE CAST(ts AS DATE) > CAST({_SQL_NOW} AS DATE) - 7
    """
)
def sources_sketched(spark, sf_dir):
    """The exact number of sources, and whether the merged sketches of the days come near it.

    Near is within four standard deviations.
    """
    events, now = _events(spark, sf_dir)
    sketches = materialize(source_sketches(events, ts="ts", source="user_id"), "sketches")
    first = F.date_sub(day_key(instant(now)), 6)

    def compared(days, rows, sketched):
        about = sources_of_sketches(sketched).scalar()
        exact = active_sources(rows, "user_id").select(F.col("active_sources").alias("exact"))
        near = F.abs(about - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * SKETCH_ERROR * F.col("exact"))
        return exact.select(F.lit(days).alias("days"), "exact", near.alias("near"))

    week = events.where(day_key(F.col("ts")) >= first)
    return compared("all days", events, sketches).unionByName(compared("week", week, sketches.where(F.col("day") >= first)))

"""Dashboard counts kept up to date while rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from feedloom.functions.dates import Instant, day_key, days_ago, midnight
from feedloom.functions.fixed import DASHBOARD_DAYS
from feedloom.operators.metrics import category_or_other, fill_days
from feedloom.session import require_utc
from feedloom.sources import versions

ROLLUP = StructType(
    [
        StructField("day", DateType()),
        StructField("category", StringType()),
        StructField("source_name", StringType()),
        StructField("n", LongType()),
        StructField("batch_id", LongType()),
    ]
)

# What a batch or a folded version holds: ``counts`` per day, category and source, and rows
# per unit of time in tiers. The finest tier has each instant that occurs.
_COUNTS = "counts"
_TIERS = ("day", "hour", "minute", "instant")
_STORED = StructType([*ROLLUP.fields[:4], StructField("start", TimestampType()), StructField("tier", StringType())])


def stream_daily(sdf: DataFrame, ts: str = "published_at", delay: str | None = None) -> DataFrame:
    """Rows per UTC day as ``(day, n)``, for update or complete mode.

    With ``delay`` the count of a day is final, and its state is dropped, once the
    watermark has passed it. :func:`feedloom.operators.metrics.fill_days` puts the
    result on the seven bars.
    """
    if delay:
        sdf = sdf.withWatermark(ts, delay)
    return (
        sdf.groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "n")
    )


def stream_rollup(
    sdf: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "60 seconds",
    ts: str = "published_at",
) -> StreamingQuery:
    """Keep counts per day, category and source of a stream of inserted rows, and by time.

    Every micro-batch is reduced to its counts, in a folder of its own that a
    replay overwrites. Refreshing a dashboard then reads these few rows, not the
    table. After edits or deletes rebuild it with :func:`rebuild_rollup`, and from time
    to time fold its folders into one with :func:`compact_rollup`.
    ``interval`` None processes what is there and stops.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id > folded_through(batch.sparkSession, path):
            write_rollup(batch, path, batch_id, ts)

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        sdf.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def write_rollup(rows: DataFrame, path: str, batch_id: int = 0, ts: str = "published_at") -> None:
    """The counts of one batch, complete once its folder has ``_SUCCESS``."""
    _write(_counts(rows, ts), _times(rows, ts), f"{path}/batch_id={batch_id}")


def _write(counts: DataFrame, times: DataFrame, path: str) -> None:
    both = counts.withColumns({"start": F.lit(None).cast("timestamp"), "tier": F.lit(_COUNTS)}).unionByName(
        times, allowMissingColumns=True
    )
    # Sorted by time, so that a count since some instant reads few row groups of a tier.
    laid_out = both.hint("rebalance", "tier").sortWithinPartitions("tier", "start", "day")
    laid_out.write.mode("overwrite").partitionBy("tier").parquet(path)


def _counts(rows: DataFrame, ts: str) -> DataFrame:
    require_utc(rows.sparkSession)
    keys = (day_key(F.col(ts)).alias("day"), "category", "source_name")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _times(rows: DataFrame, ts: str) -> DataFrame:
    """Rows per instant, minute, hour and day, each as ``tier, start, n``; undated ones in none."""
    instants = rows.select(F.col(ts).cast("timestamp").alias("start")).where("start IS NOT NULL")
    counted = instants.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    units = F.array(*[F.struct(F.lit(t).alias("tier"), _begin(t).alias("start")) for t in _TIERS])
    tiers = counted.select(F.explode(units).alias("unit"), "n")
    return tiers.groupBy("unit").agg(F.sum("n").alias("n")).select("unit.*", "n")


def _begin(tier: str) -> Column:
    return F.col("start") if tier == "instant" else F.date_trunc(tier, F.col("start"))


def folded_through(spark: SparkSession, path: str) -> int:
    """The last batch that a rebuild or compaction has folded in; -1 if there was none."""
    return versions.newest(spark, path).get("through", -1)


def _batches(spark: SparkSession, path: str, after: int) -> list[int]:
    """Complete batches behind ``after``."""
    names = (name.removeprefix("batch_id=") for name in versions.children(spark, path) if name.startswith("batch_id="))
    numbers = sorted(int(name) for name in names)
    return [n for n in numbers if n > after and versions.exists(spark, f"{path}/batch_id={n}/_SUCCESS")]


def _folded(path: str, version: int) -> str:
    return f"{path}/_folded/v={version}"


def _stored(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """All rows of a state: those of its folded version and of the batches behind it."""
    state = versions.newest(spark, path) if state is None else state
    through = state.get("through", -1)
    found = spark.createDataFrame([], _STORED).withColumn("batch_id", F.lit(0).cast("long"))
    if "folded" in state:
        folded = spark.read.schema(_STORED).parquet(_folded(path, state["folded"]))
        found = found.unionByName(folded.withColumn("batch_id", F.lit(-2 - through).cast("long")))
    folders = [f"{path}/batch_id={n}" for n in _batches(spark, path, through)]
    if folders:
        schema = StructType([*_STORED.fields, ROLLUP["batch_id"]])
        found = found.unionByName(spark.read.schema(schema).option("basePath", path).parquet(*folders))
    return found


def _replace(counts: DataFrame, times: DataFrame, path: str, state: dict, through: int) -> None:
    """Publish a folded version in the place of ``state`` and of the batches up to ``through``.

    Readers go from the old counts to the new ones when the pointer is written. What
    ``state`` itself had replaced is deleted then; what is replaced now stays until the next
    time, for those who are reading it.
    """
    spark = counts.sparkSession
    number = max([state["version"], *(int(v.removeprefix("v=")) for v in versions.children(spark, f"{path}/_folded"))]) + 1
    _write(counts, times, _folded(path, number))
    versions.publish(spark, path, state, {"folded": number, "through": through})
    for name in versions.children(spark, f"{path}/_folded"):
        if int(name.removeprefix("v=")) not in (number, state.get("folded")):
            versions.remove(spark, f"{path}/_folded/{name}")
    for batch in _batches(spark, path, -1):
        if batch <= state.get("through", -1):
            versions.remove(spark, f"{path}/batch_id={batch}")


def _last(spark: SparkSession, path: str, state: dict) -> int:
    return max([state.get("through", -1), *_batches(spark, path, -1)])


def rebuild_rollup(news: DataFrame, path: str, ts: str = "published_at") -> None:
    """Count the table anew, after edits and deletes. The stream must not be running.

    Also for a folder written before counts by time were kept.
    """
    spark = news.sparkSession
    state = versions.newest(spark, path)
    _replace(_counts(news, ts), _times(news, ts), path, state, _last(spark, path, state))


def compact_rollup(spark: SparkSession, path: str) -> None:
    """Fold all complete batches into one version, while the stream goes on and others read.

    A batch that is folded in is not added again when it is replayed. Of two compactions
    at once one fails with :class:`~feedloom.sources.versions.Superseded`, which changes
    nothing.
    """
    state = versions.newest(spark, path)
    through = _last(spark, path, state)
    stored = _stored(spark, path, state).where(F.col("batch_id") <= through)
    counts = stored.where(F.col("tier") == _COUNTS).groupBy("day", "category", "source_name")
    times = stored.where(F.col("tier") != _COUNTS).groupBy("tier", "start")
    n = F.sum("n").alias("n")
    _replace(counts.agg(n), times.agg(n), path, state, through)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Counts per day, category and source; those folded together have a ``batch_id`` below 0."""
    return _stored(spark, path).where(F.col("tier") == _COUNTS).select(*ROLLUP.names)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """Rows per unit of time, as ``tier, start, n``; a unit has a row for each batch."""
    return _stored(spark, path).where(F.col("tier") != _COUNTS).select("tier", "start", "n")


def count_since(times: DataFrame, bound: Column) -> DataFrame:
    """Rows at or after ``bound``, exact to the instant, from whole units of time.

    Days behind the bound's day count as they are, then the hours behind its hour in that
    day, the minutes behind its minute in that hour, and the instants of that minute. Of
    each tier no more is read: fewer than 24 hours, 60 minutes and one minute's instants.
    """
    parts, end = [], None
    for tier in _TIERS:
        unit = times.where(F.col("tier") == tier)
        if tier == "instant":
            first = bound
        else:
            begun = F.date_trunc(tier, bound)
            first = F.when(begun == bound, begun).otherwise(begun + F.expr(f"INTERVAL 1 {tier}"))
        unit = unit.where(F.col("start") >= first)
        parts.append(unit if end is None else unit.where(F.col("start") < end))
        end = first
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def rollup_kpis(spark: SparkSession, path: str, now: Instant, tz: str = "UTC") -> DataFrame:
    """The KPI row of :func:`feedloom.operators.metrics.kpis` without a scan of the table."""
    stored = _stored(spark, path)
    times = stored.where(F.col("tier") != _COUNTS).select("tier", "start", "n")
    totals = rollup_totals(stored.where(F.col("tier") == _COUNTS))
    # One row each.
    return totals.select(
        "total",
        count_since(times, days_ago(now, DASHBOARD_DAYS)).scalar().alias("week_total"),
        count_since(times, midnight(now, tz)).scalar().alias("today_total"),
        "active_sources",
    )


def rollup_totals(rollup: DataFrame) -> DataFrame:
    """``total`` and ``active_sources``, equal to those of the KPI row."""
    missing = F.coalesce(F.max(F.when(F.col("source_name").isNull(), 1).otherwise(0)), F.lit(0))
    return rollup.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        (F.count_distinct("source_name") + missing).alias("active_sources"),
    )


def rollup_categories(rollup: DataFrame) -> DataFrame:
    return (
        rollup.groupBy(category_or_other(F.col("category")).alias("name"))
        .agg(F.sum("n").alias("value"))
        .orderBy(F.desc("value"), "name")
    )


def rollup_daily(rollup: DataFrame, now: Instant, lang: str = "en") -> DataFrame:
    return fill_days(rollup.select("day", "n"), now, lang)

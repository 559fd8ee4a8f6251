"""Incremental publication and filters on streams of articles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.dates import Instant, recent_cutoff
from feedloom.functions.fixed import RECENT_HOURS
from feedloom.operators.publish import KEY, append_new, append_numbered
from feedloom.operators.skew import numbered
from feedloom.schema import ARTICLE
from feedloom.sources.landing import landed_articles
from feedloom.sources.payload import CORRUPT, article_reader


def _utc_now() -> Instant:
    return datetime.now(timezone.utc)


def stream_publish(
    spark: SparkSession,
    landing: str,
    news: str,
    checkpoint: str,
    clock: Callable[[], Instant] = _utc_now,
    array: bool = False,
    rejects: str | None = None,
    archive: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Publish the payload files under ``landing`` that were not published yet.

    Each file is consumed once, as recorded in ``checkpoint``; the query stops when
    all present files are done. Rows go by the time their file arrived, then by its
    name and their position, so the copy of a URL that came first wins. Batches follow
    the same time, which makes their size, ``files_per_batch`` or all files, irrelevant
    unless files of one moment fall on both sides of a boundary. A batch that is
    replayed after a crash finds its URLs in the table and adds nothing twice.

    Lines that are no article and articles without a URL go to ``rejects``, by default
    next to the table, as ``text, payload_file, reason``. With ``archive`` consumed
    files are moved there some time later.
    """
    rejects = rejects or f"{news.rstrip('/')}-rejects"
    cleaning = {"cleanSource": "archive", "sourceArchiveDir": archive} if archive else {}
    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    files = (
        article_reader(spark.readStream, array)
        .options(**cleaning, **limit)
        .json(landing)
        .select(
            *ARTICLE.names,
            CORRUPT,
            F.col("_metadata.file_modification_time").alias("payload_time"),
            F.col("_metadata.file_path").alias("payload_file"),
            F.col("_metadata.file_block_start").alias("payload_block"),
        )
    )

    def publish_batch(batch: DataFrame, batch_id: int) -> None:
        # Read once; publishing looks at the batch several times.
        rows = batch.withColumn("payload_row", F.monotonically_increasing_id()).persist()
        try:
            append_new(batch.sparkSession, rows, news, clock())
            _write_rejects(rows, f"{rejects}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return (
        files.writeStream.foreachBatch(publish_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_rejects(rows: DataFrame, path: str) -> None:
    """Keep rows that cannot be published, with the reason."""
    unkeyed = rows.where(F.col(KEY).isNull()).select(
        F.coalesce(CORRUPT, F.to_json(F.struct(*ARTICLE.names))).alias("text"),
        "payload_file",
        F.when(F.col(CORRUPT).isNotNull(), "unreadable").otherwise("no source_url").alias("reason"),
    )
    unkeyed.write.mode("overwrite").json(path)


def _slices(rows: DataFrame, files: int | None) -> list[tuple[datetime, datetime] | None]:
    """First and last times of slices of at least ``files`` files, none part of a moment.

    The files of a micro-batch are listed on the driver anyway, to plan it.
    """
    if not files:
        return [None]
    moments = rows.groupBy("payload_time").agg(F.count_distinct("payload_file").alias("n"))
    slices, held = [], 0
    for moment, n in moments.orderBy("payload_time").collect():
        if held == 0:
            slices.append((moment, moment))
        slices[-1] = (slices[-1][0], moment)
        held = held + n if held + n < files else 0
    return slices


def stream_publish_ordered(
    spark: SparkSession,
    landing: str,
    news: str,
    checkpoint: str,
    clock: Callable[[], Instant] = _utc_now,
    array: bool = False,
    rejects: str | None = None,
    files_per_publication: int | None = None,
    settle: float = 2.0,
    interval: str | None = None,
) -> StreamingQuery:
    """:func:`stream_publish` by a source whose offsets are times of arrival.

    A micro-batch takes everything between two of these, see
    :func:`feedloom.sources.landing.landed_articles`, and never part of the files of one
    moment. It is published in slices of about ``files_per_publication`` files, whole moments
    each, or at once. The copy of a URL that came first wins whatever the size of batches
    and slices, also among files of equal time, which go by name. ``interval`` keeps the
    stream running; None takes what is there and stops.
    """
    rejects = rejects or f"{news.rstrip('/')}-rejects"

    def publish_batch(batch: DataFrame, batch_id: int) -> None:
        rows = numbered(batch, "landed")
        for times in _slices(rows, files_per_publication):
            part = rows if times is None else rows.where(F.col("payload_time").between(*map(F.lit, times)))
            append_numbered(batch.sparkSession, part, news, clock())
        _write_rejects(rows, f"{rejects}/batch_id={batch_id}")

    return (
        landed_articles(spark, landing, array, settle)
        .writeStream.foreachBatch(publish_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if interval is None else {"processingTime": interval}))
        .start()
    )


def stream_dedupe(
    sdf: DataFrame,
    key: str = KEY,
    ts: str = "published_at",
    delay: str = "24 hours",
    shares: int = 16,
) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of each other.

    State is dropped behind the watermark, so this is not uniqueness for all
    time; the anti-join in :func:`stream_publish` is. Rows are shuffled by key, and
    a key with very many rows would load one task, so repeats are first dropped
    within ``shares`` groups of input tasks. Only one row per group is left for the
    second step. A single group leaves the first step out.
    """
    marked = sdf.withWatermark(ts, delay)
    if shares > 1:
        # The same on every attempt of a task, unlike a random number, and spread
        # also when the rows are exact copies, unlike a hash of them.
        part = F.pmod(F.spark_partition_id(), F.lit(shares))
        marked = marked.withColumn("_part", part).dropDuplicatesWithinWatermark([key, "_part"])
        marked = marked.drop("_part")
    return marked.dropDuplicatesWithinWatermark([key])


def stream_recent(
    sdf: DataFrame, ts: str, hours: int = RECENT_HOURS, now: Instant | None = None
) -> DataFrame:
    """Rows at most ``hours`` older than the clock of their micro-batch.

    A watermark would follow the greatest event time seen instead of the clock.
    """
    cutoff = recent_cutoff(F.current_timestamp() if now is None else now, hours)
    return sdf.where(F.col(ts) >= cutoff.cast(sdf.schema[ts].dataType))

"""Insert-if-new publication of article batches, keyed by ``source_url``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import Instant, day_key, instant
from feedloom.functions.fixed import DUPLICATE_MARKERS
from feedloom.operators.harvest import first_by_key
from feedloom.operators.skew import fits_broadcast, join_by_key, numbered, rows_numbered
from feedloom.schema import NEWS
from feedloom.session import materialize
from feedloom.sources.news import append_news, news_of
from feedloom.sources.payload import PAYLOAD_ORDER

KEY = "source_url"

# New rows are written where they are read, without a shuffle, when they are more than
# this many and more than one in this many of their batch.
_MANY, _SHARE = 1 << 14, 8


def known_keys(batch: DataFrame, news: DataFrame) -> DataFrame:
    """The batch's URLs that the table has, each once."""
    return _known_keys(batch, news)[0]


def _known_keys(batch: DataFrame, news: DataFrame) -> tuple[DataFrame, bool]:
    """:func:`known_keys`, and whether they fit a broadcast.

    Only one column of the table is read. The usual batch is small next to the
    table: if its distinct URLs are measured to fit, they are broadcast and the
    table is not shuffled at all. Otherwise both sides are reduced to distinct
    URLs before they meet, so copies of a URL never travel.
    """
    wanted = batch.select(KEY).where(F.col(KEY).isNotNull()).distinct()
    present = news.select(KEY)
    if fits_broadcast(wanted):
        return present.join(F.broadcast(wanted), KEY, "left_semi").distinct(), True
    return wanted.join(present.distinct(), KEY, "left_semi"), False


def new_only(batch: DataFrame, news: DataFrame) -> DataFrame:
    """Rows of a batch with unique URLs whose URL the table does not have."""
    return _without_known(batch, *_known_keys(batch, news))


def _without_known(unique: DataFrame, known: DataFrame, fits: bool) -> DataFrame:
    return unique.join(F.broadcast(known) if fits else known, KEY, "left_anti")


def already_known(batch: DataFrame, news: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose URL the table has; URLs may repeat in the batch."""
    known, fits = _known_keys(batch, news)
    return join_by_key(batch, known, [KEY], "left_semi", list(order), fits)


def classify_error(message: Column) -> Column:
    """``duplicate`` for a uniqueness violation reported by a store, else ``error``."""
    text = F.lower(message)
    known = F.lit(False)
    for marker in DUPLICATE_MARKERS:
        known = known | F.contains(text, F.lit(marker))
    return F.when(known, F.lit("duplicate")).otherwise(F.lit("error"))


def publish(batch: DataFrame, news: DataFrame, now: Instant, order: Sequence[str]) -> DataFrame:
    """The rows of ``batch`` to add to ``news``, in the shape of the table.

    Rows go in ``order``: the first with a URL wins, and a URL the table has is
    skipped. Rows without a URL cannot be keyed and are never inserted. The id is
    a hash of the URL, so publishing again gives the same row. ``order`` columns
    are kept behind the table's columns.
    """
    keyed = batch.where(F.col(KEY).isNotNull())
    fresh = _without_known(first_by_key(keyed, KEY, list(order)), *_known_keys(keyed, news))
    return with_derived(fresh, now, order)


def with_derived(fresh: DataFrame, now: Instant, order: Sequence[str]) -> DataFrame:
    """Rows that are new to the table, in its shape, with the ``order`` columns behind."""
    published_at = instant(now)
    derived = {
        "id": F.sha2(F.col(KEY), 256),
        "published_at": published_at,
        "published_date": day_key(published_at),
    }
    if "entry_published_at" not in fresh.columns:
        derived["entry_published_at"] = F.lit(None).cast("timestamp")
    return fresh.withColumns(derived).select(*NEWS.names, *[c for c in order if c not in NEWS.names])


def outcomes(batch: DataFrame, inserted: DataFrame, order: Sequence[str]) -> DataFrame:
    """The batch with ``outcome``: ``inserted``, ``duplicate`` or ``error``.

    ``inserted`` is what :func:`publish` returned. Rows are matched by their
    unique position ``order`` rather than by URL, so that many copies of one URL
    do not meet in one task.
    """
    marks = inserted.select(*order, F.lit(True).alias("_inserted"))
    outcome = (
        F.when(F.col(KEY).isNull(), "error").when(F.col("_inserted"), "inserted").otherwise("duplicate")
    )
    return batch.join(marks, list(order), "left").withColumn("outcome", outcome).drop("_inserted")


def publish_report(outcome_rows: DataFrame) -> DataFrame:
    """One row: ``inserted``, ``skipped``, ``failed`` and ``total``."""

    def n(value: str) -> Column:
        return F.count_if(F.col("outcome") == value)

    return outcome_rows.agg(
        n("inserted").alias("inserted"),
        n("duplicate").alias("skipped"),
        n("error").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def append_new(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    now: Instant,
    order: Sequence[str] = PAYLOAD_ORDER,
) -> None:
    """Publish into the table at ``path``.

    Only the days in which the keys place URLs of the batch are read. Safe to repeat: rows that got in are skipped the next time. One writer at a
    time, since nothing but this keeps URLs unique.
    """
    append_numbered(spark, numbered(batch, "batch"), path, now, order)


def append_numbered(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    now: Instant,
    order: Sequence[str] = PAYLOAD_ORDER,
) -> DataFrame:
    """:func:`append_new` for `numbered` rows; returns the ``order`` of those that got in.

    Which rows are new is told by their URLs and places alone, and written down before the
    table changes, since asking the changed table again would call every row a duplicate.
    Their texts are only read to be written.
    """
    places = rows.select(*dict.fromkeys([KEY, *order, "_row"])).where(F.col(KEY).isNotNull())
    news = news_of(spark, path, places.select(F.sha2(F.col(KEY), 256).alias("id")))
    first = first_by_key(places, KEY, list(order))
    fresh = materialize(_without_known(first, *_known_keys(places, news)), "fresh")
    n = fresh.count()
    texts = with_derived(rows_numbered(rows, fresh), now, ())
    keys = fresh.select(KEY, F.sha2(F.col(KEY), 256).alias("id"), instant(now).alias("published_at"))
    append_news(texts, path, keys, of_one_day=n > _MANY and n * _SHARE > rows.count())
    return fresh


def publish_to(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    now: Instant,
    order: Sequence[str] = PAYLOAD_ORDER,
) -> DataFrame:
    """Like :func:`append_new`, returning the batch's outcomes.

    The batch is written down first, once: row numbers of a file scan depend on how
    the files are dealt over the cores there are, so two evaluations may differ.
    """
    rows = numbered(batch, "batch")
    return outcomes(rows.drop("_row"), append_numbered(spark, rows, path, now, order), order)

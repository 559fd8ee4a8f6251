"""Updates and deletes by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.skew import broadcast_if_small, join_by_key
from feedloom.schema import EDITABLE
from feedloom.session import materialize
from feedloom.sources.keys import days_of, in_days
from feedloom.sources.news import drop_days, read_news, replace_days


def merge_patches(patches: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per id from ``(id, patch map<string,string>, seq)``.

    Patches apply in ``seq`` order, so for each column the last one that names it
    wins. A column is a struct around the new value, or NULL if no patch names
    it: an absent key leaves the column alone, a null value sets NULL.
    """

    def last(column: str):
        named = F.map_contains_key("patch", column)
        value = F.struct(F.try_element_at("patch", F.lit(column)).alias("value"))
        return F.max_by(F.when(named, value), F.when(named, F.col(seq))).alias(f"_{column}")

    return patches.groupBy("id").agg(*[last(c) for c in EDITABLE])


def update_news(news: DataFrame, patches: DataFrame, seq: str = "seq") -> DataFrame:
    """The table with the patches applied; ids it does not have change nothing.

    Only the editable columns can change.
    """
    return apply_merged(news, merge_patches(patches, seq))


def apply_merged(news: DataFrame, merged: DataFrame) -> DataFrame:
    """:func:`update_news` for patches from :func:`merge_patches`."""
    edited = {
        c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c))
        for c in EDITABLE
    }
    joined = join_by_key(news, merged, ["id"], "left", ["source_url"])
    return joined.withColumns(edited).select(*news.columns)


def delete_news(news: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given ids; unknown and repeated ids do no harm."""
    return join_by_key(news, ids.select("id").distinct(), ["id"], "left_anti", ["source_url"])


# The edits of one call are few next to the table. Once measured to be so they are
# broadcast, which leaves the table's rows where they are read.


def apply_updates(spark: SparkSession, path: str, patches: DataFrame, seq: str = "seq") -> int:
    """Rewrite the days the patched rows may be in; returns the number of days."""
    news = read_news(spark, path)
    merged = broadcast_if_small(materialize(merge_patches(patches, seq), "patches"))
    days = days_of(spark, path, merged)
    if days:
        replace_days(apply_merged(in_days(news, days), merged), path)
    return len(days)


def apply_deletes(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Rewrite the days the deleted rows may be in; returns the number of days."""
    news = read_news(spark, path)
    gone = broadcast_if_small(materialize(ids.select("id").distinct(), "ids"))
    days = days_of(spark, path, gone)
    if days:
        kept = in_days(news, days).join(gone, "id", "left_anti")
        # Days that keep no row do not occur in the write, so they are dropped. They
        # are looked up first, since the write changes what `kept` reads.
        left = {r[0] for r in kept.select(F.col("published_date").cast("string")).distinct().collect()}
        if left:
            replace_days(kept, path)
        drop_days(spark, path, [d for d in days if d not in left])
    return len(days)

"""The ``news`` table: Parquet, partitioned by the UTC day of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import day_key
from feedloom.schema import NEWS
from feedloom.session import read_if_present, require_utc
from feedloom.sources.keys import add_keys, days_of, in_days


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """The table, or no rows if nothing was published yet.

    Filters on ``published_date`` skip whole folders; filters on other columns
    reach the row groups.
    """
    return read_if_present(lambda: spark.read.schema(NEWS).parquet(path), NEWS, spark)


def news_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The days of the table that may hold rows with these ``id``s, found by their keys.

    Other days are not read. All rows with these ids are among them.
    """
    return in_days(read_news(spark, path), days_of(spark, path, ids))


def _laid_out(df: DataFrame, of_one_day: bool = False) -> DataFrame:
    # Rebalancing brings the rows of a day together into files of the advisory
    # size, and AQE splits a day that is larger than that.
    require_utc(df.sparkSession)
    dated = df.withColumn("published_date", day_key(F.col("published_at"))).select(*NEWS.names)
    return dated if of_one_day else dated.hint("rebalance", "published_date")


# Ids are hashes, so the least and greatest of a row group say nothing about it. A
# Bloom filter lets a lookup by id skip the row groups that cannot hold it.
_LOOKUP = {"parquet.bloom.filter.enabled#id": "true", "compression": "zstd"}


def append_news(df: DataFrame, path: str, keys: DataFrame | None = None, of_one_day: bool = False) -> None:
    """Append rows to the table, their keys first; ``df`` is read for each of the two.

    ``keys`` has the rows' ids, URLs and times if the caller has these apart. Rows that are
    all ``of_one_day``, and enough to fill the files of the tasks that read them, are
    written by these tasks.
    """
    laid_out = _laid_out(df, of_one_day)
    add_keys(df if keys is None else keys, path)
    (
        laid_out
        .write.mode("append")
        .options(**_LOOKUP)
        .partitionBy("published_date")
        .parquet(path)
    )


def replace_days(df: DataFrame, path: str) -> None:
    """Replace the days that occur in ``df``; all other days stay.

    The new files are complete before any old one goes, so ``df`` may read the
    same table.
    """
    (
        _laid_out(df)
        .write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **_LOOKUP)
        .partitionBy("published_date")
        .parquet(path)
    )


def drop_days(spark: SparkSession, path: str, days: list[str | None]) -> None:
    """Remove the folders of ``days`` (``yyyy-MM-dd``, or None for undated rows)."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for day in days:
        name = day or "__HIVE_DEFAULT_PARTITION__"
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/published_date={name}")
        folder.getFileSystem(hadoop).delete(folder, True)

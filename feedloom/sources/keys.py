"""Where the rows of a stored table are: each id with its day.

The index lies beside the table and is a hint: a row may be gone, or may not have been
written because its writer failed after its keys. What it finds is therefore looked up in
the table, in the days that it names and no others. Keys are written before rows, so a row
is never without its key. A table without an index, or with one whose first write did not
end, is searched itself; whoever appends to it indexes it first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from feedloom.functions.dates import day_key
from feedloom.operators.skew import broadcast_if_small
from feedloom.schema import NEWS
from feedloom.session import materialize, path_exists, read_if_present
from feedloom.sources.runs import Runs

KEYS = StructType([StructField("id", StringType()), StructField("published_date", DateType())])


def key_runs(path: str) -> Runs:
    """The index of the table at ``path``."""
    return Runs(f"{path.rstrip('/')}-keys", KEYS)


def _named(rows: DataFrame) -> DataFrame:
    """Each row's id, and what publication would call its URL should that differ."""
    names = F.array_distinct(F.array("id", F.sha2(F.col("source_url"), 256)))
    return rows.select(F.explode(names).alias("id"), "published_date").where(F.col("id").isNotNull())


def add_keys(rows: DataFrame, path: str) -> None:
    """Index ``rows`` that are about to be appended to the table at ``path``.

    A table that has no index yet is indexed first: one of the new rows alone would hide
    the others.
    """
    spark = rows.sparkSession
    if not key_runs(path).state(spark)["version"] and path_exists(spark, path):
        rebuild_keys(spark, path)
    key_runs(path).add(_named(rows.withColumn("published_date", day_key(F.col("published_at")))))


def rebuild_keys(spark: SparkSession, path: str) -> None:
    """Index the table anew: one row per id and day, in one run. No writer may be at work."""
    key_runs(path).replace(materialize(_named(_table(spark, path)).distinct(), "keys"))


def _table(spark: SparkSession, path: str) -> DataFrame:
    return read_if_present(lambda: spark.read.schema(NEWS).parquet(path), NEWS, spark)


def days_of(spark: SparkSession, path: str, ids: DataFrame) -> list[str | None]:
    """Days that may hold rows with these ids; at most one value per calendar day.

    Only the buckets of the ids are read, at most 256 values being brought here to choose
    them. Without an index two columns of the whole table are.
    """
    ids = ids.select("id").where(F.col("id").isNotNull())
    wanted = broadcast_if_small(ids.distinct())
    state = key_runs(path).state(spark)
    if not state["version"]:
        return _days(_named(_table(spark, path)).join(wanted, "id", "left_semi"))
    found = key_runs(path).read(spark, state, key_runs(path).buckets(ids, state))
    return _days(found.join(wanted, "id", "left_semi"))


def all_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every id of the table, by its index if there is one; an id may come more than once."""
    state = key_runs(path).state(spark)
    return (key_runs(path).read(spark, state) if state["version"] else _named(_table(spark, path))).select("id")


def _days(found: DataFrame) -> list[str | None]:
    return [row[0] for row in found.select(F.col("published_date").cast("string")).distinct().collect()]


def in_days(news: DataFrame, days: list[str | None]) -> DataFrame:
    """The rows of these days; the folders of other days are not read."""
    dated = [d for d in days if d is not None]
    condition = F.col("published_date").isin([F.lit(d).cast("date") for d in dated])
    if len(dated) < len(days):
        condition = condition | F.col("published_date").isNull()
    return news.where(condition)

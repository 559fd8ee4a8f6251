"""Feed catalogues: JSON objects of ``category -> [feed url]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schema import CATALOG, CATALOG_JSON
from feedloom.session import read_if_present


def flatten_catalog(
    df: DataFrame, text: str | Column, keep: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """One row per listed feed, numbered in the order of the document.

    Text that is no catalogue lists no feeds, or fails the job with ``strict``.
    """
    keep = list(keep or [])
    column = F.col(text) if isinstance(text, str) else text
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return (
        df.select(*keep, F.posexplode(F.from_json(column, CATALOG_JSON, mode)))
        .select(
            *keep, F.col("key").alias("category"), F.col("pos").alias("category_pos"), "value"
        )
        .select(*keep, "category", "category_pos", F.posexplode("value"))
        .select(
            *keep,
            "category",
            "category_pos",
            F.col("col").alias("feed_url"),
            F.col("pos").alias("feed_pos"),
        )
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file; a missing one gives no feeds, a broken one is an error."""

    def read() -> DataFrame:
        return flatten_catalog(spark.read.text(path, wholetext=True), "value", strict=True)

    return read_if_present(read, CATALOG, spark)

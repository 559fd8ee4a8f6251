"""The hand-off between harvest and publication: JSON files of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.schema import ARTICLE
from feedloom.session import read_if_present

# Position of a row in a payload: when its file arrived, the file, offset of the read
# block in the file, row in the block. Row numbers only compare within a block.
PAYLOAD_ORDER = ("payload_time", "payload_file", "payload_block", "payload_row")

# The text of a line that is no article; NULL for one that is.
CORRUPT = "payload_text"


def write_payload(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Replace the payload at ``path`` with JSON lines; nulls and accents are kept.

    With ``order``, file names sorted by name and lines within them follow it, so
    that readers see the articles in harvest order.
    """
    if order:
        df = df.orderBy(*order)
    df.select(*ARTICLE.names).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def article_reader(reader, array: bool):
    """A batch or stream reader of payload files that keeps what it cannot read."""
    return (
        reader.schema(StructType([*ARTICLE.fields, StructField(CORRUPT, StringType())]))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", array)
    )


def number_rows(articles: DataFrame) -> DataFrame:
    """Add :data:`PAYLOAD_ORDER` to rows that come straight from a file scan."""
    return articles.select(
        *ARTICLE.names,
        CORRUPT,
        F.col("_metadata.file_modification_time").alias("payload_time"),
        F.col("_metadata.file_path").alias("payload_file"),
        F.col("_metadata.file_block_start").alias("payload_block"),
        F.monotonically_increasing_id().alias("payload_row"),
    )


def read_payload(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Articles at ``path`` with their position; no path or no rows gives none.

    A line that is no article is a row without values, with its text in :data:`CORRUPT`.

    ``array`` reads files that hold one JSON array each instead of JSON lines.
    Those are not splittable, so each file is one task.
    """
    empty = spark.createDataFrame([], ARTICLE).select(
        "*",
        F.lit(None).cast("string").alias(CORRUPT),
        F.lit(None).cast("timestamp").alias("payload_time"),
        F.lit("").alias("payload_file"),
        F.lit(0).cast("bigint").alias("payload_block"),
        F.lit(0).cast("bigint").alias("payload_row"),
    )
    return read_if_present(
        lambda: number_rows(article_reader(spark.read, array).json(path)),
        empty.schema,
        spark,
    )

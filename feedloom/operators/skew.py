"""Joins and ranks that hold up when one key has a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.session import materialize

# A key is hot when it has more than 1/HOT_SHARE of the rows, so there can never
# be HOT_SHARE hot keys: that bounds what is broadcast, whatever the data.
HOT_SHARE = 1000


# Largest side that is broadcast on purpose, after it has been measured.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` is small enough to broadcast.

    Measured, not estimated: this runs a job that brings one number back.
    """
    per_row = F.octet_length(F.to_json(F.struct("*"))) + F.lit(32)
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to fit, else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more than one row in ``HOT_SHARE``; fewer than ``HOT_SHARE`` rows."""
    counts = df.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * HOT_SHARE > total).select(*on, F.lit(True).alias("_hot"))


def join_by_key(
    rows: DataFrame,
    keys: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    fits: bool | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``rows.join(keys, on, how)`` for ``rows`` that may have hot keys.

    ``keys`` has each key once and ``how`` is inner, left, left_semi or left_anti.
    ``keys`` that fit are broadcast; ``fits`` says so if the caller knows, else they
    are measured.

    Keys that do not fit are joined by a shuffle. Rows of a hot key are dealt over
    the shuffle partitions by a hash of the ``spread`` columns, and its one ``keys``
    row is repeated for each share. Rows without a key match nothing wherever they
    are, so they are dealt out as well. ``hot`` has the hot keys, fewer than
    ``HOT_SHARE``, if the caller has counted them; else `hot_keys` does.
    """
    if fits is None:
        fits = fits_broadcast(keys)
    if fits:
        return rows.join(F.broadcast(keys), on, how)
    spark = rows.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(rows.select(*on), on) if hot is None else hot.select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    dealt_out = reduce(Column.__or__, [F.col(c).isNull() for c in on], F.col("_hot").isNotNull())
    share = F.pmod(F.xxhash64(*spread), F.lit(shares)).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_share", F.when(dealt_out, share).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(
        F.array(F.lit(0))
    )
    repeated = keys.join(hot, on, "left").withColumn("_share", F.explode(copies)).drop("_hot")
    return dealt.drop("_hot").join(repeated, [*on, "_share"], how).drop("_share")


def numbered(df: DataFrame, name: str, number: str = "_row") -> DataFrame:
    """``df`` written down once, with a number of its own for each row."""
    return materialize(df.withColumn(number, F.monotonically_increasing_id()), name, compression="zstd")


def rows_numbered(rows: DataFrame, chosen: DataFrame, number: str = "_row") -> DataFrame:
    """The rows of a `numbered` frame whose number is in ``chosen``.

    The chosen numbers travel as bitmaps, a bit for each row, so that rows with long texts
    need no shuffle to be told apart. Bitmaps that do not fit a broadcast are not used.
    """
    bucket = F.bitmap_bucket_number(number)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number))
    maps = chosen.groupBy(bucket.alias("_bucket")).agg(bits.alias("_bits"))
    if not fits_broadcast(maps):
        return rows.join(chosen.select(number), number, "left_semi").select(*rows.columns)
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket")
    return found.where(F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1).select(*rows.columns)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order``, which must have no ties.

    A window without partitions would sort everything in one task. Here the rows
    are range-partitioned and sorted, each partition numbers its own rows, and the
    number of rows in the partitions before is added. The numbered rows are
    written once, because a second evaluation may choose other ranges.
    """
    local = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", local),
        "ranked",
    )
    part = F.shiftright("_row", 33)
    row = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part)
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + row + 1).alias(name)
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, batches)

"""Validity intervals of dated changes, and the one in force at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.operators.skew import broadcast_if_small

SLICE = 86_400  # seconds


def _slice(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / SLICE)


def intervals(changes: DataFrame, on: list[str], at: str, active: str) -> DataFrame:
    """The times in which a key is active: ``on, valid_from, valid_to`` (null: still).

    ``changes`` says that a key is ``active`` or not from ``at`` on, until its next change.
    Of changes at one moment an activation wins. Keys and moments must not be null. A key
    with many changes is cut into days, so no task has to hold all of them.
    """
    once = changes.groupBy(*on, at).agg(F.max(active).alias("_active")).withColumn("_slice", _slice(F.col(at)))
    following = Window.partitionBy(*on).orderBy("_slice")
    days = once.groupBy(*on, "_slice").agg(F.min(at).alias("_first"))
    days = days.withColumn("_next", F.lead("_first").over(following)).drop("_first")
    own = F.lead(at).over(Window.partitionBy(*on, "_slice").orderBy(at))
    return (
        once.withColumn("_own", own)
        .join(days, [*on, "_slice"])
        .where("_active")
        .select(*on, F.col(at).alias("valid_from"), F.coalesce("_own", "_next").alias("valid_to"))
    )


def asof(rows: DataFrame, valid: DataFrame, on: list[str], at: str, most: int = 50_000) -> DataFrame:
    """``rows`` with the interval of their key in force at ``at``; rows without one go.

    Adds ``valid_from, valid_to``. ``valid`` is what `intervals` returns. First each day of
    a key learns the last interval begun before it, from one row per key and day. Then a
    day's rows and intervals are merged in order of time. A day of a key with over
    ``most`` rows is dealt over several tasks, each with all of that day's intervals.
    """
    begun = F.struct("valid_from", "valid_to")
    starts = valid.select(*on, _slice(F.col("valid_from")).alias("_slice"), F.col("valid_from").alias("_moment"), begun.alias("_state"))
    rows = rows.withColumn("_slice", _slice(F.col(at)))
    counts = rows.groupBy(*on, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_shares", F.ceil(F.col("_n") / most).cast("int"))

    nothing = F.lit(None).cast(valid.select(begun.alias("s")).schema["s"].dataType)
    ends = starts.groupBy(*on, "_slice").agg(F.max("_state").alias("_state"))
    days = counts.select(*on, "_slice", F.lit(0).alias("_kind"), nothing.alias("_state")).unionByName(
        ends.select(*on, "_slice", F.lit(1).alias("_kind"), "_state")
    )
    before = Window.partitionBy(*on).orderBy("_slice", "_kind")
    carried = (
        days.withColumn("_state", F.last("_state", ignorenulls=True).over(before))
        .where("_kind = 0 AND _state IS NOT NULL")
        .select(*on, "_slice", F.lit(None).cast("timestamp").alias("_moment"), "_state")
    )
    shares = counts.select(*on, "_slice", "_shares")
    events = (
        carried.unionByName(starts)
        .join(shares, [*on, "_slice"])
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
        .select(*on, "_slice", "_share", "_moment", F.lit(1).alias("_kind"), "_state")
    )
    # Fewer than one row in ``most`` of all rows.
    split = broadcast_if_small(shares.where("_shares > 1"))
    dealt = rows.join(split, [*on, "_slice"], "left").withColumn(
        "_share",
        F.when(F.col("_shares").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), "_shares")).cast("int"),
    )
    merged = dealt.drop("_shares").withColumns({"_moment": F.col(at), "_kind": F.lit(2), "_state": nothing}).unionByName(
        events, allowMissingColumns=True
    )
    order = Window.partitionBy(*on, "_slice", "_share").orderBy(F.asc_nulls_first("_moment"), "_kind")
    state = F.last("_state", ignorenulls=True).over(order)
    inside = F.col("_state").isNotNull() & (F.col("_state.valid_to").isNull() | (F.col(at) < F.col("_state.valid_to")))
    return (
        merged.withColumn("_state", state)
        .where((F.col("_kind") == 2) & inside)
        .withColumns({"valid_from": F.col("_state.valid_from"), "valid_to": F.col("_state.valid_to")})
        .drop("_slice", "_share", "_moment", "_kind", "_state")
    )

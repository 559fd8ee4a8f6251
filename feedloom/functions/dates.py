"""Instants, day keys and feed dates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.fixed import MONTHS_RFC_822, RECENT_HOURS, ZONE_OFFSETS
from feedloom.functions.once import let

Instant = datetime | str | Column


def instant(now: Instant) -> Column:
    """``now`` as a TIMESTAMP column; text and naive datetimes are read as UTC."""
    if isinstance(now, Column):
        return now
    if isinstance(now, datetime):
        if now.tzinfo is not None:
            now = now.astimezone(timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    return F.lit(now).cast("timestamp")


def like(df: DataFrame, column: str, value: Column) -> Column:
    """``value`` in the type of ``df[column]``.

    Casting the bound instead of the column leaves a plain ``column >= literal``
    that Parquet row groups can be skipped on, also for TIMESTAMP_NTZ columns.
    """
    return value.cast(df.schema[column].dataType)


def latest_instant(df: DataFrame, column: str) -> str:
    """The greatest value of a timestamp column, as text (one value to the driver)."""
    return df.agg(F.max(column).cast("string")).first()[0]


def recent_cutoff(now: Instant, hours: int = RECENT_HOURS) -> Column:
    return instant(now) - F.expr(f"INTERVAL {int(hours)} HOURS")


def days_ago(now: Instant, days: int) -> Column:
    """Exactly ``days`` times 24 hours before ``now``."""
    return instant(now) - F.expr(f"INTERVAL {int(days) * 24} HOURS")


def midnight(now: Instant, tz: str = "UTC") -> Column:
    """Start of the day of ``now`` in zone ``tz``."""
    local = F.from_utc_timestamp(instant(now), tz)
    return F.to_utc_timestamp(F.date_trunc("DAY", local), tz)


def day_key(ts: Column) -> Column:
    return F.to_date(ts)


def day_spine(now: Instant, days: int) -> Column:
    """Array of the last ``days`` UTC days in ascending order, ending today."""
    today = day_key(instant(now))
    return F.sequence(F.date_sub(today, days - 1), today, F.expr("INTERVAL 1 DAY"))


# Day, month, year, hour, minute, second and zone of an RFC 822 date. The weekday,
# the time, the seconds and the zone may be missing.
_RFC_822 = (
    r"\A(?:[A-Za-z]+\.?,?\s*)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?,?[\s-]+(\d{4}|\d{2})\b"
    r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]+|[+-](?:0\d|1[0-8]):?[0-5]\d)?)?.*\z"
)
# The C library's order, as in `Sun May  3 14:05:00 2026`.
_ASCTIME = r"\A[A-Za-z]{3} ([A-Za-z]{3})\s+(\d{1,2}) (\d\d:\d\d:\d\d) (\d{4})\z"
_FIELDS = "\x01".join(f"${i}" for i in range(1, 8))


def _rfc_822(text: Column) -> Column:
    months = F.array(*[F.lit(m) for m in MONTHS_RFC_822])
    zones = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])

    def from_fields(field: Column) -> Column:
        def number(i: int, missing: int | None = None) -> Column:
            return F.coalesce(F.get(field, F.lit(i)).try_cast("int"), F.lit(missing))

        year, month = number(2), F.array_position(months, F.lower(F.get(field, F.lit(1))))
        century = F.when(F.length(F.get(field, F.lit(2))) > 2, 0).when(year < 90, 2000).otherwise(1900)
        zone = F.when(
            F.get(field, F.lit(6)).rlike("^[+-]"), F.regexp_replace(F.get(field, F.lit(6)), r"(\d\d):?(\d\d)", "$1:$2")
        ).otherwise(F.coalesce(F.try_element_at(zones, F.upper(F.get(field, F.lit(6)))), F.lit("+00:00")))
        return F.when(
            (F.size(field) == 7) & (month > 0),
            F.try_make_timestamp(
                year + century, month.cast("int"), number(0),
                number(3, 0), number(4, 0), number(5, 0), zone,
            ),
        )

    ordered = F.regexp_replace(text, _ASCTIME, "$2 $1 $4 $3")
    return let(F.split(F.regexp_replace(ordered, _RFC_822, _FIELDS), "\x01"), from_fields)


def parse_feed_date(raw: Column) -> Column:
    """RFC 822 or ISO 8601 text to TIMESTAMP; NULL when it is neither.

    Zone names are fixed offsets: Spark would apply daylight saving rules to a name
    such as EST. Names that are not known, and no zone at all, mean UTC.
    """

    def either(text: Column) -> Column:
        # A bare time of day would also pass as ISO text, so a year is demanded.
        # Spark wants seconds before a zone.
        full = F.regexp_replace(text, r"(T\d\d:\d\d)(?=[Z+-])", "$1:00")
        return F.when(text.rlike(r"\A\d{4}-"), F.try_to_timestamp(full)).otherwise(_rfc_822(text))

    return let(F.trim(raw), either)


def entry_date(raw: Column, now: Instant) -> Column:
    """Date of an entry; an entry without a readable date counts as new."""
    return F.coalesce(parse_feed_date(raw), instant(now))

"""Language choice and display text of dates and counts.

``pt`` selects Portuguese and every other language selects English. A NULL date
gives NULL text. ``date_format`` only speaks English, so Portuguese month names
come from arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.fixed import MONTHS_LONG_PT, MONTHS_SHORT_PT, WEEKDAYS


def language(lang: str) -> str:
    return "pt" if lang == "pt" else "en"


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), index)


def _day_pt(ts: Column, months: tuple[str, ...]) -> Column:
    of = F.lit(" de ")
    return F.concat(
        F.date_format(ts, "dd"), of, _pick(months, F.month(ts)), of, F.date_format(ts, "yyyy")
    )


def weekday(day: Column, lang: str) -> Column:
    return _pick(WEEKDAYS[language(lang)], F.dayofweek(day))


def fmt_short(ts: Column, lang: str) -> Column:
    """``May 03, 2026`` or ``03 de mai. de 2026``."""
    if language(lang) == "pt":
        return _day_pt(ts, MONTHS_SHORT_PT)
    return F.date_format(ts, "MMM dd, yyyy")


def fmt_day(ts: Column, lang: str) -> Column:
    """``May 03, 2026`` or ``03 de maio de 2026``, with the month in full."""
    if language(lang) == "pt":
        return _day_pt(ts, MONTHS_LONG_PT)
    return F.date_format(ts, "MMMM dd, yyyy")


def fmt_long(ts: Column, lang: str) -> Column:
    """``May 03, 2026 at 02:05 PM`` or ``03 de maio de 2026 às 14:05``."""
    if language(lang) == "pt":
        return F.concat(fmt_day(ts, lang), F.lit(" às "), F.date_format(ts, "HH:mm"))
    return F.date_format(ts, "MMMM dd, yyyy 'at' hh:mm a")


def fmt_numeric(ts: Column, lang: str) -> Column:
    """``5/3/2026`` or ``03/05/2026``."""
    return F.date_format(ts, "dd/MM/yyyy" if language(lang) == "pt" else "M/d/yyyy")


def fmt_int(n: Column) -> Column:
    """``1,234,567``; a missing count is 0."""
    return F.format_number(F.coalesce(n, F.lit(0)), 0)

"""Dashboard: scalar counts, seven bars, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame

from feedloom.functions.dates import Instant
from feedloom.operators.metrics import category_share, daily_volume, kpis


def dashboard(
    news: DataFrame, now: Instant, lang: str = "en", tz: str = "UTC"
) -> dict[str, DataFrame]:
    """The three result tables; each reads only the columns it needs."""
    return {
        "kpis": kpis(news, now, tz),
        "daily": daily_volume(news, now, lang),
        "categories": category_share(news),
    }

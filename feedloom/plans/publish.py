"""Publication of a payload file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.functions.dates import Instant
from feedloom.operators.publish import publish_report, publish_to
from feedloom.sources.payload import read_payload


def publish_payload(
    spark: SparkSession, payload: str, news: str, now: Instant, array: bool = False
) -> DataFrame:
    """Publish a payload into the table and return the tally.

    A payload that is absent or empty publishes nothing. Publishing the same
    payload twice adds nothing the second time, so it need not be deleted; use
    :func:`feedloom.streaming.publish.stream_publish` to read each file once.
    """
    return publish_report(publish_to(spark, read_payload(spark, payload, array), news, now))

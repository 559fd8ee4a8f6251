"""A stream that remembers every URL."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators.publish import append_new
from feedloom.session import materialize
from feedloom.sources import versions
from feedloom.sources.news import read_news
from feedloom.sources.payload import read_payload
from feedloom.streaming import unique
from feedloom.streaming.unique import stream_publish_unique
from tests.test_landing import NOW, land, line, titles


def run(spark, landing, news, checkpoint, **options):
    query = stream_publish_unique(spark, str(landing), news, str(checkpoint), clock=lambda: NOW, settle=0, **options)
    query.awaitTermination()
    return query


def test_urls_are_unique_over_runs_and_the_table_before(spark, tmp_path, monkeypatch):
    landing, news, checkpoint = tmp_path / "in", str(tmp_path / "news"), tmp_path / "cp"
    old = tmp_path / "old"
    land(old, "0.json", 50, line("old", "old"))
    append_new(spark, read_payload(spark, str(old)), news, NOW)
    land(landing, "b.json", 100, line("1", "b"), line("1", "b again"), line("old", "b"), line(None, "no url"), "broken")
    land(landing, "a.json", 101, line("1", "a"), line("2", "a"))
    run(spark, landing, news, checkpoint)
    want = {"old": "old", "1": "b", "2": "a"}
    assert titles(spark, news) == want
    assert {r.reason for r in spark.read.json(f"{news}-rejects").collect()} == {"unreadable", "no source_url"}
    # From now on nothing looks at the keys.
    monkeypatch.setattr(unique, "append_new", lambda *_: pytest.fail("keys were read"))
    land(landing, "0.json", 102, line("2", "late"), line("3", "late"), line("old", "late"))
    run(spark, landing, news, checkpoint)
    run(spark, landing, news, checkpoint)
    assert titles(spark, news) == want | {"3": "late"}
    assert read_news(spark, news).count() == 4


@pytest.mark.parametrize("failing", ["append", "rejects"])
def test_a_batch_whose_writer_failed_is_replayed(spark, tmp_path, monkeypatch, failing):
    landing, news, checkpoint = tmp_path / "in", str(tmp_path / "news"), tmp_path / "cp"
    land(landing, "a.json", 100, line("1", "a"), line("2", "a"))
    name = "append_news" if failing == "append" else "_write_rejects"
    real = getattr(unique, name)

    def broken(*args):
        raise OSError("the writer was lost")

    monkeypatch.setattr(unique, name, broken)
    with pytest.raises(Exception, match="the writer was lost"):
        run(spark, landing, news, checkpoint)
    monkeypatch.setattr(unique, name, real)
    run(spark, landing, news, checkpoint)
    assert titles(spark, news) == {"1": "a", "2": "a"}
    assert read_news(spark, news).count() == 2
    assert versions.newest(spark, f"{checkpoint}-published")["done"] == 0


def test_a_hot_url_sends_few_rows(spark):
    rows = spark.range(20_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("at")
    )
    reduced = materialize(rows.mapInArrow(unique._one_per_batch("id", ["at"]), rows.schema), "reduced")
    assert reduced.where("id = 'hot'").count() <= 4
    assert reduced.agg(F.min(F.when(F.col("id") == "hot", F.col("at")))).first()[0] == 0
    assert reduced.select("id").distinct().count() == rows.select("id").distinct().count()

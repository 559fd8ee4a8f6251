"""Rows told apart by numbers, so that long texts are not shuffled."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import publish as publication
from feedloom.operators import skew
from feedloom.operators.skew import numbered, rows_numbered
from feedloom.schema import ARTICLE
from feedloom.sources.news import read_news

NOW = "2026-05-04 12:00:00"


def stored(spark, n, parts=3):
    return numbered(spark.range(n, numPartitions=parts).select("id", F.lit("long").alias("text")), "test")


@pytest.mark.parametrize("fits", [True, False])
def test_the_rows_of_numbers(spark, monkeypatch, fits):
    rows = stored(spark, 100_000)
    want = "id % 3 = 0 OR id IN (0, 1, 32767, 32768, 32769, 99999)"
    chosen = rows.where(want).select("_row")
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: fits)
    found = rows_numbered(rows, chosen)
    assert found.columns == rows.columns
    assert found.exceptAll(rows.where(want)).isEmpty() and rows.where(want).exceptAll(found).isEmpty()
    assert rows_numbered(rows, chosen.limit(0)).isEmpty()


def test_texts_are_not_shuffled_to_be_chosen(spark):
    rows = stored(spark, 1000)
    plan = rows_numbered(rows, rows.where("id % 2 = 0").select("_row"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("many", [0, 1 << 14])
def test_first_copies_are_published_by_either_layout(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(publication, "_MANY", many)
    path = str(tmp_path / "news")
    shuffled = []
    laid_out = publication.append_news
    monkeypatch.setattr(
        publication, "append_news", lambda *a, **k: (shuffled.append(not k["of_one_day"]), laid_out(*a, **k))
    )
    url = F.when(F.col("id") % 7 == 6, F.lit(None)).otherwise((F.col("id") % 50).cast("string"))
    batch = spark.range(100, numPartitions=4).withColumns({c: F.lit("x") for c in ARTICLE.names}).withColumns(
        {"source_url": url, "title_en": F.col("id").cast("string"), "pos": -F.col("id")}
    )
    publication.append_new(spark, batch.where("id < 20"), path, NOW, ["pos"])
    publication.append_new(spark, batch, path, NOW, ["pos"])
    want = {}
    for ids in (range(20), range(100)):
        new = {str(i % 50): str(i) for i in ids if i % 7 != 6 and str(i % 50) not in want}
        want |= new
    got = [(r.source_url, r.title_en) for r in read_news(spark, path).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert shuffled == [many > 0] * 2

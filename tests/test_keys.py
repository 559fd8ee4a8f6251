"""The key index stays small while publications go on."""

import os
from datetime import date, timedelta

from pyspark.sql import functions as F

from feedloom.schema import NEWS
from feedloom.sources import versions
from feedloom.sources.keys import add_keys, days_of, key_runs, rebuild_keys
from feedloom.sources.news import append_news, read_news
from feedloom.sources.runs import BASE, FAN

DAY = date(2026, 5, 1)


def rows(spark, first, n, day):
    named = spark.range(first, first + n, numPartitions=1).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("source_url")
    )
    given = named.withColumn("published_at", F.lit(str(day)).cast("timestamp")).withColumn("published_date", F.lit(day))
    return given.select(*[F.col(c) if c in given.columns else F.lit(None).cast(NEWS[c].dataType).alias(c) for c in NEWS.names])


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def runs(spark, path):
    return versions.newest(spark, f"{path}-keys")["runs"]


def test_fifty_publications_leave_few_files(spark, tmp_path):
    path = str(tmp_path / "news")
    for i in range(50):
        add_keys(rows(spark, 10 * i, 10, DAY + timedelta(days=i)), path)
        levels = [run["level"] for run in runs(spark, path)]
        assert all(levels.count(level) < FAN for level in levels)
        # Written in base FAN, the number of publications has a digit for each level.
        assert sum(FAN**level for level in levels) == i + 1
    on_disk = os.listdir(f"{path}-keys/runs")
    assert len(on_disk) <= len(runs(spark, path)) + FAN
    found = {
        name: len([f for _, _, files in os.walk(f"{path}-keys/runs/{run['name']}") for f in files if f.endswith(".parquet")])
        for run in runs(spark, path)
        for name in [run["name"]]
    }
    assert sum(found.values()) < 60
    for i in (0, 7, 15, 16, 31, 48, 49):
        assert days_of(spark, path, ids(spark, f"id{10 * i + 3}", "none")) == [str(DAY + timedelta(days=i))]
    by_url = spark.sql("SELECT sha2('u355', 256) AS id")
    assert days_of(spark, path, by_url) == [str(DAY + timedelta(days=35))]
    assert days_of(spark, path, ids(spark, "none")) == []


def test_an_index_of_all_levels_gives_what_a_rebuilt_one_gives(spark, tmp_path):
    path = str(tmp_path / "news")
    for i in range(6):
        append_news(rows(spark, 4 * i, 6, DAY + timedelta(days=i % 4)), path)
    asked = ids(spark, *(f"id{i}" for i in range(0, 30, 3)))
    before = sorted(days_of(spark, path, asked))
    rebuild_keys(spark, path)
    assert [run["level"] for run in runs(spark, path)] == [BASE]
    assert sorted(days_of(spark, path, asked)) == before == ["2026-05-01", "2026-05-02", "2026-05-03", "2026-05-04"]
    append_news(rows(spark, 100, 1, DAY), path)
    assert days_of(spark, path, ids(spark, "id100")) == [str(DAY)]
    assert read_news(spark, path).count() == 37


def test_nothing_new_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "news")
    add_keys(rows(spark, 0, 0, DAY), path)
    assert not os.path.exists(f"{path}-keys")
    add_keys(rows(spark, 0, 1, DAY), path)
    state = versions.newest(spark, f"{path}-keys")
    add_keys(rows(spark, 0, 0, DAY), path)
    assert versions.newest(spark, f"{path}-keys") == state


def test_readers_of_a_state_can_end_while_runs_are_merged(spark, tmp_path):
    path = str(tmp_path / "news")
    for i in range(FAN - 1):
        add_keys(rows(spark, i, 1, DAY), path)
    state = runs(spark, path)
    begun = key_runs(path).read(spark, {"runs": state})
    add_keys(rows(spark, 50, 1, DAY), path)
    assert [run["level"] for run in runs(spark, path)] == [1]
    assert begun.select("id").distinct().count() == 2 * (FAN - 1)

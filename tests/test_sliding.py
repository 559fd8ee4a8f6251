"""Counts by time kept by a stream, and versions replaced while they are read."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.functions.dates import instant
from feedloom.operators.metrics import SKETCH_ERROR, active_sources, kpis, source_sketches, sources_of_sketches
from feedloom.sources import versions
from feedloom.streaming.metrics import (
    compact_rollup,
    count_since,
    folded_through,
    read_rollup,
    read_times,
    rebuild_rollup,
    rollup_kpis,
    rollup_totals,
    stream_rollup,
    write_rollup,
)

START = datetime(2026, 4, 20)


def inserted(spark, n=4000, seed=1):
    chance = random.Random(seed)
    times = [START + timedelta(microseconds=chance.randrange(15 * 86_400 * 10**6)) for _ in range(n)]
    # Rows on whole minutes, hours and days, in their last microsecond, and at one instant.
    times += [START + timedelta(minutes=m) for m in range(0, 15 * 1440, 37)]
    times += [START + timedelta(hours=h, microseconds=-1) for h in range(1, 300)]
    times += [START + timedelta(days=5)] * 50
    rows = [(t.isoformat(sep=" "), f"c{i % 3}", f"s{i % 7}" if i % 11 else None) for i, t in enumerate(times)]
    rows += [(None, "c0", "s0")] * 5
    df = spark.createDataFrame(rows, "ts string, category string, source_name string")
    return df.select(F.col("ts").cast("timestamp").alias("published_at"), "category", "source_name"), times


def test_counts_since_any_instant(spark, tmp_path):
    rows, times = inserted(spark)
    path = str(tmp_path / "rollup")
    for batch in range(3):
        write_rollup(rows.where(F.pmod(F.xxhash64("published_at"), F.lit(3)) == batch), path, batch)
    chance = random.Random(2)
    bounds = [START + timedelta(microseconds=chance.randrange(15 * 86_400 * 10**6)) for _ in range(6)]
    bounds += [chance.choice(times) for _ in range(4)]
    bounds += [START + timedelta(days=5), START + timedelta(days=5, hours=3), START + timedelta(minutes=74), START - timedelta(days=9)]
    bounds += [START + timedelta(days=5, microseconds=-1), START + timedelta(days=6, microseconds=-1), START + timedelta(days=40)]

    def counts():
        stored = read_times(spark, path).cache()
        frames = [count_since(stored, instant(b)) for b in bounds]
        return [f.first()[0] for f in frames]

    want = [sum(t >= b for t in times) for b in bounds]
    assert counts() == want
    compact_rollup(spark, path)
    assert counts() == want


def test_kpis_equal_the_table_at_any_moment(spark, tmp_path):
    rows, _ = inserted(spark, 600)
    folder = tmp_path / "in"
    rows.repartition(4).write.parquet(str(folder))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    path = str(tmp_path / "rollup")
    assert rollup_kpis(spark, path, "2026-05-01").first() == (0, 0, 0, 0)
    stream_rollup(source, path, str(tmp_path / "cp"), interval=None).awaitTermination()
    for now, tz in (("2026-05-04 12:34:56.789012", "UTC"), ("2026-04-30", "America/Sao_Paulo"), ("2026-04-28 23:59:59.999999", "Asia/Kathmandu")):
        assert rollup_kpis(spark, path, now, tz).first() == kpis(rows, now, tz).first()


def test_few_rows_are_read(spark, tmp_path):
    """Edges are found in whole units: no tier gives more rows than its parent has parts."""
    rows, times = inserted(spark)
    path = str(tmp_path / "rollup")
    write_rollup(rows, path)
    compact_rollup(spark, path)
    bound = START + timedelta(days=7, hours=13, minutes=29, seconds=31)
    times_read = read_times(spark, path)
    # A folded version has one row per unit.
    assert times_read.groupBy("tier", "start").count().where("count > 1").isEmpty()
    assert count_since(times_read, instant(bound)).first()[0] == sum(t >= bound for t in times)
    plan = count_since(times_read, instant(bound))._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(tier") >= 4 and "PushedFilters: [IsNotNull(start), GreaterThanOrEqual(start" in plan


def test_readers_see_old_or_new_counts_while_versions_change(spark, tmp_path):
    rows, _ = inserted(spark, 500)
    path = str(tmp_path / "rollup")
    total = rows.count()
    for batch in range(3):
        write_rollup(rows.where(F.pmod(F.xxhash64("published_at"), F.lit(3)) == batch), path, batch)
    begun = rollup_totals(read_rollup(spark, path))
    compact_rollup(spark, path)
    assert begun.first().total == total == rollup_totals(read_rollup(spark, path)).first().total
    # The stream goes on; a batch that was folded in and is written again is not read.
    write_rollup(rows, path, 3)
    write_rollup(rows, path, 2)
    assert rollup_totals(read_rollup(spark, path)).first().total == 2 * total
    before = rollup_totals(read_rollup(spark, path))
    compact_rollup(spark, path)
    assert folded_through(spark, path) == 3
    assert before.first().total == 2 * total == rollup_totals(read_rollup(spark, path)).first().total
    write_rollup(rows, path, 4)
    compact_rollup(spark, path)
    assert rollup_totals(read_rollup(spark, path)).first().total == 3 * total
    assert sorted(os.listdir(f"{path}/_folded")) == ["v=2", "v=3"]
    assert [p for p in os.listdir(path) if p.startswith("batch_id=")] == ["batch_id=4"]
    rebuild_rollup(rows, path)
    assert rollup_totals(read_rollup(spark, path)).first().total == total


def test_unfinished_writes_are_not_read(spark, tmp_path):
    rows, _ = inserted(spark, 100)
    path = str(tmp_path / "rollup")
    write_rollup(rows, path, 0)
    write_rollup(rows, path, 1)
    os.remove(f"{path}/batch_id=1/_SUCCESS")
    assert rollup_totals(read_rollup(spark, path)).first().total == rows.count()
    compact_rollup(spark, path)
    assert folded_through(spark, path) == 0
    # A pointer whose writer failed counts as not there, and its number is not used again.
    (tmp_path / "rollup" / "_versions" / "000000000002.json").write_text('{"folded": ')
    assert versions.newest(spark, path)["version"] == 1
    compact_rollup(spark, path)
    assert versions.newest(spark, path)["version"] == 3
    assert rollup_totals(read_rollup(spark, path)).first().total == rows.count()


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path)
    seen = versions.newest(spark, path)
    assert seen == {"version": 0}
    first = versions.publish(spark, path, seen, {"a": "é"})
    assert versions.newest(spark, path) == first == {"a": "é", "version": 1}
    with pytest.raises(versions.Superseded):
        versions.publish(spark, path, seen, {"a": 2})
    assert json.loads((tmp_path / "_versions" / "000000000001.json").read_text()) == {"a": "é"}


def test_sketches_of_days_merge(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.timestamp_seconds(1_777_000_000 + F.col("id") % 20 * 86_400).alias("published_at"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 7001).cast("string")).alias("source_name"),
    )
    sketches = source_sketches(rows)
    assert sketches.count() == 20
    exact = active_sources(rows).first()[0]
    about = sources_of_sketches(sketches).first()[0]
    assert abs(about - exact) <= 4 * SKETCH_ERROR * exact
    few = rows.where("id < 40")
    assert sources_of_sketches(source_sketches(few)).first()[0] == active_sources(few).first()[0] == 37
    assert sources_of_sketches(source_sketches(rows.limit(0))).first()[0] == 0

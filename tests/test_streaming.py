"""Streaming forms give what their batch forms give."""

import json
from collections import Counter

from pyspark.sql import functions as F

from feedloom.operators.harvest import first_by_key
from feedloom.operators.metrics import category_distribution, daily_volume, fill_days, kpis
from feedloom.plans.publish import publish_payload
from feedloom.schema import ARTICLE
from feedloom.sources.news import append_news, read_news
from feedloom.streaming.metrics import (
    read_rollup,
    rollup_categories,
    rollup_daily,
    rollup_totals,
    stream_daily,
    stream_rollup,
    write_rollup,
)
from feedloom.streaming.publish import stream_dedupe, stream_publish, stream_recent

NOW = "2026-05-04 12:00:00"


def land(folder, name, *articles):
    folder.mkdir(exist_ok=True)
    lines = []
    for url, title in articles:
        row = dict.fromkeys(ARTICLE.names, "x") | {"source_url": url, "title_en": title}
        lines.append(json.dumps({k: v for k, v in row.items() if v is not None}))
    (folder / name).write_text("\n".join(lines) + "\n")


def titles(spark, path):
    return {r.source_url: r.title_en for r in read_news(spark, path).collect()}


def test_payload_files_are_published_once(spark, tmp_path):
    landing, news, checkpoint = tmp_path / "in", str(tmp_path / "news"), str(tmp_path / "cp")
    rejects = str(tmp_path / "rejects")

    def run(checkpoint=checkpoint):
        stream_publish(
            spark, str(landing), news, checkpoint, clock=lambda: NOW, rejects=rejects
        ).awaitTermination()

    land(landing, "1.json", ("a", "first"), ("b", "b"), ("a", "second"))
    land(landing, "2.json", ("b", "late"), ("c", "c"), (None, "no url"))
    run()
    want = {"a": "first", "b": "b", "c": "c"}
    assert titles(spark, news) == want
    land(landing, "3.json", ("a", "again"), ("d", "d"))
    run()
    assert titles(spark, news) == want | {"d": "d"}
    run()
    # A lost checkpoint replays everything; the table still has each URL once.
    run(checkpoint=str(tmp_path / "other"))
    assert titles(spark, news) == want | {"d": "d"}
    assert read_news(spark, news).count() == 4
    (reject,) = spark.read.json(f"{rejects}/batch_id=0").collect()
    assert reject.reason == "no source_url" and '"title_en":"no url"' in reject.text


def test_consumed_files_can_be_archived(spark, tmp_path):
    landing, archive, news = tmp_path / "in", tmp_path / "done", str(tmp_path / "news")
    for name in ("1.json", "2.json", "3.json"):
        land(landing, name, (name, "t"))
    for _ in range(2):
        stream_publish(
            spark, str(landing), news, str(tmp_path / "cp"),
            clock=lambda: NOW, archive=str(archive), files_per_batch=1,
        ).awaitTermination()
    assert set(titles(spark, news)) == {"1.json", "2.json", "3.json"}
    assert {p.name for p in archive.rglob("*.json")} & {"1.json", "2.json"}


def test_payload_run(spark, tmp_path):
    news, path = str(tmp_path / "news"), tmp_path / "payload.json"
    rows = [dict.fromkeys(ARTICLE.names, "x") | {"source_url": u} for u in ("a", "b", "a")]
    assert tuple(publish_payload(spark, str(path), news, NOW, array=True).first()) == (0, 0, 0, 0)
    path.write_text(json.dumps(rows))
    assert tuple(publish_payload(spark, str(path), news, NOW, array=True).first()) == (2, 1, 0, 3)
    assert tuple(publish_payload(spark, str(path), news, NOW, array=True).first()) == (0, 3, 0, 3)
    assert read_news(spark, news).count() == 2


def stamped(spark, *rows):
    return spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))


def run_to_end(spark, sdf, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    (
        sdf.writeStream.outputMode(mode)
        .foreachBatch(lambda df, _: df.write.mode("append" if mode == "append" else "overwrite").parquet(out))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out)


def as_stream(spark, df, path, files=4):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(path))


def test_dedupe_under_skew(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 60).alias("ts"),
    )
    for shares in (1, 16):
        folder = tmp_path / str(shares)
        folder.mkdir()
        source = as_stream(spark, rows, folder / "in")
        got = run_to_end(spark, stream_dedupe(source, "k", "ts", "1 hour", shares), folder)
        assert Counter(r.k for r in got.collect()) == Counter({r.k: 1 for r in rows.select("k").distinct().collect()})


def test_recent_follows_the_clock_not_the_data(spark, tmp_path):
    rows = stamped(spark, ("old", "2026-05-03 11:00:00"), ("edge", "2026-05-03 12:00:00"), ("future", "2026-06-01"))
    source = as_stream(spark, rows, tmp_path / "in", 3)
    got = run_to_end(spark, stream_recent(source, "ts", now=NOW), tmp_path)
    assert {r.k for r in got.collect()} == {"edge", "future"}


def test_daily_counts_fill_the_same_bars(spark, tmp_path):
    rows = spark.range(500).select(
        F.lit("k").alias("k"),
        F.timestamp_seconds(1_777_000_000 + F.col("id") * 2400).alias("ts"),
    )
    source = as_stream(spark, rows, tmp_path / "in")
    days = run_to_end(spark, stream_daily(source, "ts"), tmp_path, "complete")
    want = daily_volume(rows, NOW, ts="ts").collect()
    assert fill_days(days, NOW).collect() == want and sum(r["count"] for r in want) > 0


def test_rollup_equals_the_table(spark, tmp_path):
    rows = spark.range(900).select(
        F.timestamp_seconds(1_777_000_000 + F.col("id") * 1200).alias("published_at"),
        F.element_at(F.array(F.lit("AI"), F.lit(""), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("category"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("string")).alias("source_name"),
    )
    source = as_stream(spark, rows, tmp_path / "in")
    path = str(tmp_path / "rollup")
    assert rollup_totals(read_rollup(spark, path)).first() == (0, 0)
    stream_rollup(source, path, str(tmp_path / "cp"), interval=None).awaitTermination()
    rollup = read_rollup(spark, path)
    assert rollup.select("batch_id").distinct().count() == 2
    assert rollup_categories(rollup).collect() == category_distribution(rows).collect()
    assert rollup_daily(rollup, NOW).collect() == daily_volume(rows, NOW).collect()
    whole = kpis(rows, NOW).first()
    assert rollup_totals(rollup).first() == (whole.total, whole.active_sources)
    # Replaying a batch replaces its counts.
    write_rollup(rows.limit(0), path, 0)
    write_rollup(rows, path, 1)
    assert rollup_totals(read_rollup(spark, path)).first().total == 900

"""Payload files in the order of their arrival, whatever the batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.schema import ARTICLE
from feedloom.sources.landing import landed_articles
from feedloom.sources.news import read_news
from feedloom.sources.payload import CORRUPT
from feedloom.streaming.publish import stream_publish_ordered

NOW = "2026-05-04 12:00:00"


def line(url, title):
    return json.dumps(dict.fromkeys(ARTICLE.names, "x") | {"source_url": url, "title_en": title}, ensure_ascii=False)


def land(folder, name, moment, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))
    os.utime(folder / name, ns=(moment * 10**9, moment * 10**9))


def titles(spark, path):
    return {r.source_url: r.title_en for r in read_news(spark, path).collect()}


def rows_of(spark, tmp_path, landing, name, **options):
    """All rows of the stream; a second run of the same checkpoint adds what is new."""
    out = str(tmp_path / name)
    (
        landed_articles(spark, str(landing), settle=0, **options)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out).orderBy("payload_time", "payload_file", "payload_block", "payload_row").collect()


@pytest.mark.parametrize("files", [None, 1, 2, 3])
def test_the_first_to_arrive_wins_in_batches_of_any_size(spark, tmp_path, files):
    landing, news = tmp_path / "in", str(tmp_path / "news")

    def run():
        stream_publish_ordered(
            spark, str(landing), news, str(tmp_path / "cp"), clock=lambda: NOW, files_per_publication=files, settle=0
        ).awaitTermination()

    # Names go against times; b and c came at one moment, so the name decides between them.
    land(landing, "z.json", 100, line("1", "z"), line("2", "z"), line("1", "z again"))
    land(landing, "c.json", 200, line("3", "c"), line("2", "c"), line("4", "c"))
    land(landing, "b.json", 200, line("3", "b"), line("1", "b"))
    land(landing, "a.json", 300, line("4", "a"), line("5", "a"), "no json", "", line(None, "no url"))
    run()
    want = {"1": "z", "2": "z", "3": "b", "4": "c", "5": "a"}
    assert titles(spark, news) == want
    rejects = {(r.reason, "no json" in r.text) for r in spark.read.json(f"{news}-rejects").collect()}
    assert rejects == {("unreadable", True), ("no source_url", False)}
    land(landing, "0.json", 400, line("5", "late"), line("6", "late"))
    run()
    run()
    assert titles(spark, news) == want | {"6": "late"}
    assert read_news(spark, news).count() == 6


def test_files_are_split_at_lines(spark, tmp_path):
    landing = tmp_path / "in"
    lines = [line(str(i), "é" * (i * 7 % 90)) for i in range(200)]
    land(landing, "a.json", 100, *lines)
    land(landing, "b.json", 100, "", lines[3], "")
    land(landing, ".hidden", 100, lines[0])
    land(landing, "_tmp", 100, lines[0])
    land(landing, "empty.json", 100)
    for split in (64, 999, 1 << 20):
        got = rows_of(spark, tmp_path, landing, f"rows-{split}", split_bytes=split)
        assert [r.title_en for r in got] == [json.loads(x)["title_en"] for x in [*lines, lines[3]]]
        assert len({(r.payload_file, r.payload_block, r.payload_row) for r in got}) == 201
        assert all(r[CORRUPT] is None for r in got)


def test_arrays(spark, tmp_path):
    landing = tmp_path / "in"
    land(landing, "a.json", 100, "[" + line("1", "one"), "," + line("2", "two") + "]")
    land(landing, "b.json", 100, " [ ] ")
    land(landing, "c.json", 100, "[broken")
    got = rows_of(spark, tmp_path, landing, "rows", array=True)
    assert [(r.source_url, r[CORRUPT]) for r in got] == [("1", None), ("2", None), (None, "[broken")]


def test_a_restart_goes_on_behind_its_offset(spark, tmp_path):
    landing = tmp_path / "in"
    land(landing, "b.json", 100, line("1", "b"))
    assert len(rows_of(spark, tmp_path, landing, "rows")) == 1
    land(landing, "a.json", 101, line("2", "a"))
    got = rows_of(spark, tmp_path, landing, "rows")
    assert [r.source_url for r in got] == ["1", "2"]
    assert [r.payload_time.timestamp() for r in got] == [100, 101]


def test_young_files_wait(spark, tmp_path):
    landing = tmp_path / "in"
    land(landing, "old.json", 100, line("1", "old"))
    (landing / "young.json").write_text(line("2", "young"))
    news = str(tmp_path / "news")
    stream_publish_ordered(
        spark, str(landing), news, str(tmp_path / "cp"), clock=lambda: NOW, settle=3600
    ).awaitTermination()
    assert titles(spark, news) == {"1": "old"}
    assert read_news(spark, news).where(F.col("source_url") == "2").isEmpty()

"""Results that must not depend on sizes, on evaluation or on the order of arrival."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions.dates import parse_feed_date
from feedloom.functions.response import parse_object
from feedloom.operators.edit import apply_deletes, apply_updates, delete_news, update_news
from feedloom.operators.enrich import enrich_capped
from feedloom.operators.publish import publish, publish_report, publish_to
from feedloom.operators.serve import get_stored, latest
from feedloom.plans.harvest import candidates, harvest_by_model
from feedloom.schema import ARTICLE
from feedloom.sources.feeds import parse_feeds
from feedloom.sources.keys import add_keys, days_of, rebuild_keys
from feedloom.sources.news import append_news, read_news
from feedloom.sources.payload import PAYLOAD_ORDER, read_payload
from feedloom.streaming.metrics import (
    compact_rollup,
    folded_through,
    read_rollup,
    rebuild_rollup,
    rollup_totals,
    write_rollup,
)
from feedloom.streaming.publish import stream_publish

NOW = "2026-05-04 12:00:00"


def land(folder, name, *urls, age=0):
    folder.mkdir(parents=True, exist_ok=True)
    rows = [dict.fromkeys(ARTICLE.names, "x") | {"source_url": u, "title_en": name} for u in urls]
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
    os.utime(folder / name, (1_700_000_000 - age, 1_700_000_000 - age))


@pytest.mark.parametrize("files_per_batch", [1, 2, 1000, None])
def test_the_copy_that_arrived_first_wins(spark, tmp_path, files_per_batch):
    landing, news = tmp_path / "in", str(tmp_path / "news")
    for age, name in enumerate(("a.json", "c.json", "b.json", "d.json")):
        land(landing, name, "u", name, age=age * 10)
    stream_publish(
        spark, str(landing), news, str(tmp_path / "cp"), clock=lambda: NOW, files_per_batch=files_per_batch
    ).awaitTermination()
    found = {r.source_url: r.title_en for r in read_news(spark, news).collect()}
    assert found["u"] == "d.json" and len(found) == 5


def test_a_feed_is_asked_to_its_second_answer_and_no_further(spark):
    calls = spark.sparkContext.accumulator(0)

    def client():
        def call(text):
            calls.add(1)
            return {"title_en": text} if text == "ok" else None

        return call

    rows = spark.range(4000).select(
        F.lit("c").alias("category"),
        F.lit(None).cast("string").alias("feed_url"),
        F.col("id").cast("int").alias("pos"),
        F.when((F.col("id") == 1000) | (F.col("id") >= 1500), "ok").otherwise("no").alias("clean"),
    )
    found = enrich_capped(rows, client)
    assert sorted(r.pos for r in found.collect()) == [1000, 1500]
    assert calls.value == 1501


def test_latest_by_another_time_reads_all_days(spark, tmp_path):
    path = str(tmp_path / "news")
    rows = [(str(i), "2026-05-04" if i < 5 else "2025-01-01", f"2026-05-0{1 + i % 4}") for i in range(9)]
    rows.append(("new", "2020-01-01", "2026-06-01"))
    df = spark.createDataFrame(rows, "id string, published_at string, entry_published_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "entry_published_at")})
    append_news(df.withColumns({c: F.lit("x") for c in ARTICLE.names}).withColumn("published_date", F.lit(None)), path)
    news = read_news(spark, path)
    assert [r.id for r in latest(news, 2, ts="entry_published_at", now=NOW).collect()][0] == "new"
    assert latest(news, 3, now=NOW).collect() == latest(news, 3).collect()


def test_the_tally_does_not_depend_on_a_second_scan(spark, tmp_path):
    payload, news = tmp_path / "payload", str(tmp_path / "news")
    for i in range(12):
        land(payload, f"{i:02}.json", *(f"u{i}-{k}" for k in range(5)))
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        outcomes = publish_to(spark, read_payload(spark, str(payload)), news, NOW)
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        assert tuple(publish_report(outcomes).first()) == (60, 0, 0, 60)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_unreadable_lines_keep_their_text(spark, tmp_path):
    landing, news = tmp_path / "in", str(tmp_path / "news")
    land(landing, "1.json", "a")
    with (landing / "1.json").open("a") as out:
        out.write('{"source_url": "cut\n')
    assert sorted(r.payload_text or "" for r in read_payload(spark, str(landing)).collect()) == ["", '{"source_url": "cut']
    stream_publish(spark, str(landing), news, str(tmp_path / "cp"), clock=lambda: NOW).awaitTermination()
    (reject,) = spark.read.json(f"{news}-rejects/batch_id=0").collect()
    assert (reject.text, reject.reason) == ('{"source_url": "cut', "unreadable")
    assert read_news(spark, news).count() == 1


def rss(*titles):
    items = "".join(f"<item><title>{t}</title><link>{t}</link></item>" for t in titles)
    return f"<rss><channel><title>f</title>{items}</channel></rss>"


def test_a_run_sees_the_newest_document_once(spark):
    docs = [("A", "u", "2026-01-01 00:00:00", rss("old")), ("A", "u", "2026-05-04 11:00:00", rss("a", "b", "c"))]
    docs.append(("A", "u", "2026-05-05 00:00:00", rss("future")))
    payloads = spark.createDataFrame(docs, "category string, feed_url string, fetched_at string, payload string")
    payloads = payloads.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    catalog = spark.createDataFrame(
        [("A", "u", 0, 0), ("A", "u", 0, 1)], "category string, feed_url string, category_pos int, feed_pos int"
    )
    found = candidates(payloads, catalog, NOW)
    assert sorted((r.title, r.feed_pos) for r in found.collect()) == [("a", 0), ("b", 0), ("c", 0)]
    assert candidates(payloads, catalog, NOW, fetched_since="2026-05-04 11:30:00").count() == 0

    def sender():
        def send(body):
            request = json.loads(body)
            assert request["format"] == "json" and "Article Excerpt" in request["prompt"]
            title = request["prompt"].strip().splitlines()[-1]
            return "broken" if title == "a" else json.dumps({"response": json.dumps({"title_en": title.upper()})})

        return send

    articles = harvest_by_model(payloads, catalog, sender, NOW)
    assert sorted(r.title_en for r in articles.collect()) == ["B", "C"]


def test_a_rebuilt_rollup_counts_each_row_once(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = spark.range(100).select(
        F.lit(NOW).cast("timestamp").alias("published_at"),
        F.lit("c").alias("category"),
        (F.col("id") % 7).cast("string").alias("source_name"),
    )
    for batch in range(3):
        write_rollup(rows.where(F.col("source_name") % 3 == batch), path, batch)
    compact_rollup(spark, path)
    assert folded_through(spark, path) == 2
    assert rollup_totals(read_rollup(spark, path)).first().total == 100
    rebuild_rollup(rows.where("source_name <> '0'"), path)
    assert folded_through(spark, path) == 2
    assert rollup_totals(read_rollup(spark, path)).first().total == rows.where("source_name <> '0'").count()
    # What the compaction had replaced is gone; what it made stays for those who read it.
    assert [p for p in os.listdir(path) if p.startswith("batch_id=")] == []
    assert len(os.listdir(f"{path}/_folded")) == 2


def test_days_are_refused_in_another_zone(spark, tmp_path):
    row = spark.range(1).select(F.lit(NOW).cast("timestamp").alias("published_at"), F.lit("c").alias("category"), F.lit("s").alias("source_name"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        with pytest.raises(RuntimeError, match="UTC"):
            write_rollup(row, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "text", ['{"a":"1"}],[{"b":"2"}', '{"a":"1"}],"w":[{"b":"2"}', '{"a":"1"},"x"],[{"b":"2"}', '{"a":"1"} ]']
)
def test_two_values_are_no_object(spark, text):
    df = spark.createDataFrame([(text,), ('{"a":"]"}',)], "t string")
    assert [r[0] for r in df.select(parse_object(F.col("t"))).collect()] == [None, {"a": "]"}]


def test_edits_do_not_shuffle_the_table(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    news = spark.range(10).select(F.col("id").cast("string").alias("id"), *(F.lit("x").alias(c) for c in ARTICLE.names))
    news = news.unionByName(news.limit(1).withColumn("id", F.lit(None).cast("string")))
    patches = spark.createDataFrame([("3", {"title_en": "new"}, 1)], "id string, patch map<string,string>, seq int")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        updated, deleted = update_news(news, patches), delete_news(news, patches.select("id"))
        for df in (updated, deleted):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert updated.where("title_en = 'new'").count() == 1 and updated.count() == 11
        assert deleted.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_atom_details(spark):
    entry = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>t</title>'
        '<link rel="alternate" type="text/html" href="page"/><link rel="alternate" type="application/json" href="json"/>'
        "<issued>2020-01-01T00:00:00Z</issued></entry></feed>"
    )
    df = spark.createDataFrame([("A", "u", entry)], "category string, feed_url string, payload string")
    (row,) = parse_feeds(df).collect()
    assert (row.link, row.published_raw) == ("page", "2020-01-01T00:00:00Z")
    zones = spark.createDataFrame([("Mon, 04 May 2026 12:00:00 ET",), ("Mon, 04 May 2026 12:00:00 MET",)], "d string")
    hours = [r[0] for r in zones.select(F.hour(parse_feed_date(F.col("d")))).collect()]
    assert hours == [17, 11]


def stored(spark, path, days):
    rows = [(f"id{i}", f"u{i}", f"2026-05-{1 + i % days:02} 10:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, source_url string, published_at string")
    df = df.withColumn("published_at", F.col("published_at").cast("timestamp"))
    others = {c: F.lit("x") for c in ARTICLE.names if c != "source_url"}
    append_news(df.withColumns(others | {"entry_published_at": F.lit(None).cast("timestamp")}), path)


def test_a_lookup_reads_the_day_of_its_key(spark, tmp_path):
    path = str(tmp_path / "news")
    stored(spark, path, 20)
    found = get_stored(spark, path, "id7")
    assert [r.source_url for r in found.collect()] == ["u7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_date" in plan
    assert days_of(spark, path, spark.createDataFrame([("id7",), ("none",), (None,)], "id string")) == ["2026-05-08"]
    assert get_stored(spark, path, "none").count() == 0
    rebuild_keys(spark, path)
    assert days_of(spark, path, spark.createDataFrame([("id7",)], "id string")) == ["2026-05-08"]


def test_a_table_without_keys_is_searched_and_then_indexed(spark, tmp_path):
    """As stored by an earlier version, or copied without the folder beside it."""

    def copied(name):
        shutil.copytree(tmp_path / "whole", tmp_path / name)
        return str(tmp_path / name)

    payload = tmp_path / "payload"
    land(payload, "1.json", "a", "b")
    publish_to(spark, read_payload(spark, str(payload)), str(tmp_path / "whole"), NOW)
    stored(spark, str(tmp_path / "whole"), 3)
    looked, edited, cut, published = (copied(n) for n in ("looked", "edited", "cut", "published"))
    assert [r.source_url for r in get_stored(spark, looked, "id7").collect()] == ["u7"]
    patch = spark.createDataFrame([("id7", {"title_en": "new"}, 1)], "id string, patch map<string,string>, seq long")
    assert apply_updates(spark, edited, patch) == 1
    assert get_stored(spark, edited, "id7").first().title_en == "new"
    assert apply_deletes(spark, cut, spark.createDataFrame([("id7",)], "id string")) == 1
    assert read_news(spark, cut).where("id = 'id7'").count() == 0
    land(payload, "2.json", "c")
    for expected in ((1, 2, 0, 3), (0, 3, 0, 3)):
        assert tuple(publish_report(publish_to(spark, read_payload(spark, str(payload)), published, NOW)).first()) == expected
    # Rows from before the index are found by it too, by id and by URL.
    assert days_of(spark, published, spark.createDataFrame([("id7",)], "id string")) == ["2026-05-02"]
    by_url = spark.sql("SELECT sha2('u7', 256) AS id")
    assert days_of(spark, published, by_url) == ["2026-05-02"]


def test_keys_without_rows_hide_no_article(spark, tmp_path):
    """A writer that failed after its keys: the next run inserts the rows, once."""
    payload, news = tmp_path / "payload", str(tmp_path / "news")
    land(payload, "1.json", "a", "b")
    fresh = publish(read_payload(spark, str(payload)), read_news(spark, news), NOW, PAYLOAD_ORDER)
    add_keys(fresh, news)
    for expected in ((2, 0, 0, 2), (0, 2, 0, 2)):
        assert tuple(publish_report(publish_to(spark, read_payload(spark, str(payload)), news, NOW)).first()) == expected
    assert read_news(spark, news).count() == 2


def test_intermediate_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    table = session.materialize(spark.range(3), "passing")
    (folder,) = session._SCRATCH
    assert table.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert session.remove_intermediates(spark) == 1
    assert not os.path.exists(folder.removeprefix("file:"))

"""Harvest, enrichment, publication, edits and reports on small frames."""

from collections import Counter

import duckdb
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from feedloom.functions.dates import instant
from feedloom.operators import skew
from feedloom.operators.edit import apply_deletes, apply_updates, delete_news, update_news
from feedloom.operators.enrich import enrich, enrich_capped, json_client
from feedloom.operators.harvest import (
    cap_per_feed,
    content,
    enriched_only,
    first_by_key,
    harvest_report,
    recent,
    to_article,
)
from feedloom.operators.metrics import (
    active_sources,
    category_distribution,
    category_share,
    daily_volume,
    kpis,
    week_total,
)
from feedloom.operators.publish import (
    already_known,
    classify_error,
    known_keys,
    outcomes,
    publish,
    publish_report,
)
from feedloom.operators.serve import get_article, latest, listing, localize, newest_first
from feedloom.operators.skew import join_by_key, ranked, union_batches
from feedloom.schema import NEWS
from feedloom.session import materialize
from feedloom.sources.news import append_news, read_news

NOW = "2026-05-04 12:00:00"


def test_recency_bounds(spark):
    rows = spark.createDataFrame(
        [(1, "2026-05-03 12:00:00"), (2, "2026-05-03 11:59:59.999999"), (3, "2030-01-01"), (4, None)],
        "id int, ts string",
    )
    for kind in ("timestamp", "timestamp_ntz"):
        typed = rows.withColumn("ts", F.col("ts").cast(kind))
        assert {r.id for r in recent(typed, "ts", NOW).collect()} == {1, 3}


def test_content_keeps_an_empty_summary(spark):
    rows = spark.createDataFrame([(None, "t"), ("", "t"), ("s", "t")], "s string, t string")
    assert [r[0] for r in rows.select(content(F.col("s"), F.col("t"))).collect()] == ["t", "", "s"]


def test_article_defaults(spark):
    rows = spark.createDataFrame(
        [("c", None, "l", "t", {"summary_en": "s"}), ("c", "f", "l", "t", {"title_en": None})],
        "category string, feed_title string, link string, title string, answer map<string,string>",
    )
    assert [tuple(r) for r in to_article(rows).collect()] == [
        ("c", "Unknown Source", "l", "t", "", "s", ""),
        ("c", "f", "l", None, "", "", ""),
    ]


# --- caps and enrichment -----------------------------------------------------


def counting_client(calls):
    """Answers ``ok...`` texts; counts its calls over all tasks."""

    def connect():
        def call(text):
            calls.add(1)
            if text is None or text.startswith("raise"):
                raise RuntimeError(text)
            if text.startswith("none"):
                return None
            if text.startswith("empty"):
                return {}
            return {"title_en": text, "n": 1, "missing": None}

        return call

    return connect


FEEDS = {
    "early": ["ok", "ok", "ok", "ok"],
    "late": ["raise", "none", "empty", "raise", "none", "ok", "raise", "ok", "ok"],
    "one": ["none", "ok", "none"],
    "never": ["raise"] * 12,
    "short": ["ok"],
    "very late": ["none"] * 30 + ["ok", "none", "ok", "ok"],
}


def feed_rows(spark):
    rows = [("c", f, p, f"{t} {p}") for f, ts in FEEDS.items() for p, t in enumerate(ts)]
    schema = "category string, feed_url string, pos int, clean string"
    return spark.createDataFrame(rows, schema).repartition(5)


def expected_cap():
    return {
        (feed, pos)
        for feed, texts in FEEDS.items()
        for pos in [p for p, t in enumerate(texts) if t == "ok"][:2]
    }


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("blocks", [(1,), (2, 3), (32, 256), (4, 4, 4, 64)])
def test_capped_enrichment_equals_full_enrichment(spark, monkeypatch, blocks, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    calls, capped_calls = (spark.sparkContext.accumulator(0) for _ in range(2))
    rows = feed_rows(spark)
    full = cap_per_feed(enriched_only(enrich(rows, counting_client(calls))))
    capped = enrich_capped(rows, counting_client(capped_calls), blocks=blocks)
    order = ["feed_url", "pos"]
    assert full.orderBy(order).collect() == capped.select(full.columns).orderBy(order).collect()
    assert {(r.feed_url, r.pos) for r in capped.collect()} == expected_cap()
    first = capped.where("feed_url = 'early'").first()
    assert first.answer == {"title_en": first.clean, "n": "1", "missing": None}


def test_capped_enrichment_calls_as_few_times_as_a_sequential_run(spark):
    calls = spark.sparkContext.accumulator(0)
    capped = enrich_capped(feed_rows(spark), counting_client(calls), blocks=(4, 64))
    capped.collect(), capped.count()  # results are stored, so nothing is asked again
    needed = 0
    for texts in FEEDS.values():
        found = 0
        for text in texts:
            needed += 1
            found += text == "ok"
            if found == 2:
                break
    assert calls.value == needed


def test_small_blocks_are_not_asked_one_after_the_other(spark):
    def client():
        return lambda text: {"task": str(TaskContext.get().partitionId())}

    rows = spark.range(200).select(
        F.lit("c").alias("category"), F.col("id").cast("string").alias("feed_url"),
        F.lit(0).alias("pos"), F.lit("t").alias("clean"),
    )
    asked = enrich_capped(rows, client)
    assert asked.select("answer.task").distinct().count() > 8


def test_one_feed_may_hold_nearly_all_rows(spark):
    calls = spark.sparkContext.accumulator(0)
    hot = spark.range(20_000).select(
        F.lit("c").alias("category"),
        F.lit("hot").alias("feed_url"),
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") < 50, "none").otherwise("ok").alias("clean"),
    )
    capped = enrich_capped(hot, counting_client(calls), blocks=(8, 16, 64))
    assert sorted(r.pos for r in capped.collect()) == [50, 51]
    assert calls.value == 52


def test_json_client(spark):
    def send():
        return lambda text: text

    rows = spark.createDataFrame(
        [('{"response":"{\\"a\\":\\"b\\"}"}',), ("bad",), ('{"x":1}',)], "clean string"
    )
    got = [r.answer for r in enrich(rows, json_client(send)).collect()]
    assert got == [{"a": "b"}, None, None]


def test_first_wins(spark):
    rows = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c")], "k string, o int, x string")
    assert {(r.k, r.x) for r in first_by_key(rows, "k", ["o"]).collect()} == {("u", "a"), ("v", "c")}


def test_harvest_report(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "3")], "category string, feed_url string")
    got = {(r.category, r.feed_url, r.level): r.articles for r in harvest_report(rows).collect()}
    assert got == {
        ("a", "1", 0): 2, ("a", "2", 0): 1, ("b", "3", 0): 1,
        ("a", None, 1): 3, ("b", None, 1): 1, (None, None, 3): 4,
    }


# --- joins and ranks under skew ----------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("fits", [True, False, None])
def test_join_by_key_equals_join(spark, how, fits):
    n = F.col("id")
    rows = spark.range(6000).select(
        "id",
        F.when(n % 3 == 0, "hot").when(n % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (n % 100).cast("string"))).alias("k"),
    )
    keys = spark.createDataFrame([("hot", 1), ("k5", 2), ("k8", 3), ("none", 4)], "k string, v int")
    plain = rows.join(keys, "k", how)
    spread = join_by_key(rows, keys, ["k"], how, ["id"], fits)
    assert Counter(spread.select(plain.columns).collect()) == Counter(plain.collect())


def test_hot_keys_are_spread(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    keys = rows.select("k").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_by_key(rows, keys, ["k"], "inner", ["id"], fits=False)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6000 and max(sizes) < 1500


def test_ranks(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).cast("timestamp").alias("published_at")
    )
    got = ranked(rows.repartition(7), newest_first()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    want = rows.orderBy(*newest_first()).collect()
    assert [r.id for r in got] == [r.id for r in want]
    assert ranked(rows.limit(0), newest_first()).count() == 0


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert sorted(map(tuple, union_batches(a, b, a).collect())) == [(1, "x"), (1, "x"), (2, "y")]


# --- publication -------------------------------------------------------------

BATCH = "pos int, source_url string, " + ", ".join(
    f"{c} string" for c in "category source_name title_en title_pt summary_en summary_pt".split()
)


def batch(spark, *urls):
    return spark.createDataFrame(
        [(i, u, "c", "s", f"t{i}", "p", "e", "q") for i, u in enumerate(urls)], BATCH
    )


def table(spark, *urls):
    rows = batch(spark, *urls)
    return publish(rows, spark.createDataFrame([], NEWS), "2026-01-01", ["pos"]).select(*NEWS.names)


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, -1])
def test_publish_semantics(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    news = table(spark, "old", "other")
    rows = batch(spark, "new", "old", "new", None, "newer", "old")
    fresh = publish(rows, news, NOW, ["pos"])
    assert {(r.source_url, r.pos) for r in fresh.collect()} == {("new", 0), ("newer", 4)}
    row = fresh.where("pos = 0").first()
    assert str(row.published_at) == NOW and str(row.published_date) == "2026-05-04" and len(row.id) == 64
    marked = outcomes(rows, fresh, ["pos"])
    assert [r.outcome for r in marked.orderBy("pos").collect()] == [
        "inserted", "duplicate", "duplicate", "error", "inserted", "duplicate"
    ]
    assert tuple(publish_report(marked).first()) == (2, 3, 1, 6)
    assert {r.pos for r in already_known(rows, news, ["pos"]).collect()} == {1, 5}
    again = publish(rows, news.unionByName(fresh.select(*NEWS.names)), NOW, ["pos"])
    assert again.count() == 0
    assert publish(rows.limit(0), news, NOW, ["pos"]).count() == 0
    report = publish_report(outcomes(rows.limit(0), fresh.limit(0), ["pos"])).first()
    assert tuple(report) == (0, 0, 0, 0)


def test_lookups_can_skip_row_groups(spark, tmp_path):
    append_news(table(spark, "u"), str(tmp_path / "news"))
    filtered = duckdb.sql(
        f"SELECT path_in_schema FROM parquet_metadata('{tmp_path}/news/*/*.parquet')"
        " WHERE bloom_filter_offset IS NOT NULL"
    ).fetchall()
    assert filtered == [("id",)]


def test_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    append_news(table(spark, "old"), str(tmp_path / "news"))
    news = read_news(spark, str(tmp_path / "news"))
    plan = known_keys(batch(spark, "old"), news)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_error_classes(spark):
    rows = spark.createDataFrame(
        [('Duplicate KEY value violates',), ("UNIQUE constraint failed",), ("timeout",), (None,)], "m string"
    )
    got = [r[0] for r in rows.select(classify_error(F.col("m"))).collect()]
    assert got == ["duplicate", "duplicate", "error", "error"]


# --- edits -------------------------------------------------------------------


def patches(spark, *rows):
    return spark.createDataFrame(
        [(i, p, s) for s, (i, p) in enumerate(rows)], "id string, patch map<string,string>, seq int"
    )


def small_news(spark):
    return spark.createDataFrame(
        [("1", "c", "s", "u1", "a", "b"), ("2", "c", "s", "u2", "a", "b"), ("3", "c", "s", "u3", "a", "b")],
        "id string, category string, source_name string, source_url string, title_en string, title_pt string",
    ).select("*", F.lit("x").alias("summary_en"), F.lit("y").alias("summary_pt"))


def test_updates(spark):
    changes = patches(
        spark,
        ("1", {"title_en": "first"}),
        ("1", {"title_en": "second", "category": None}),
        ("2", {}),
        ("3", {"source_url": "no", "id": "9", "title_pt": ""}),
        ("unknown", {"title_en": "z"}),
    )
    got = {r.id: r for r in update_news(small_news(spark), changes).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].title_en, got["1"].category, got["1"].title_pt) == ("second", None, "b")
    assert (got["2"].title_en, got["2"].category) == ("a", "c")
    assert (got["3"].source_url, got["3"].title_pt, got["3"].title_en) == ("u3", "", "a")


def test_deletes(spark):
    ids = spark.createDataFrame([("1",), ("1",), ("unknown",)], "id string")
    assert {r.id for r in delete_news(small_news(spark), ids).collect()} == {"2", "3"}


def test_edits_of_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "news")
    days = {"a": "2026-01-01", "b": "2026-01-01", "c": "2026-01-02", "d": "2026-01-03", "e": None}
    for url, day in days.items():
        rows = table(spark, url).withColumn("published_at", F.lit(day).cast("timestamp"))
        append_news(rows, path)
    ids = {r.source_url: r.id for r in read_news(spark, path).collect()}
    assert set(ids) == set(days)
    untouched = sorted(p.name for p in (tmp_path / "news" / "published_date=2026-01-03").glob("*.parquet"))

    assert apply_updates(spark, path, patches(spark, (ids["a"], {"title_en": "A"}), (ids["e"], {"title_en": "E"}))) == 2
    got = {r.source_url: r.title_en for r in read_news(spark, path).collect()}
    assert got == {"a": "A", "b": "t0", "c": "t0", "d": "t0", "e": "E"}

    gone = spark.createDataFrame([(ids["b"],), (ids["c"],), (ids["e"],), ("unknown",)], "id string")
    assert apply_deletes(spark, path, gone) == 3
    got = {r.source_url: r.title_en for r in read_news(spark, path).collect()}
    assert got == {"a": "A", "d": "t0"}
    left = sorted(p.name for p in (tmp_path / "news" / "published_date=2026-01-03").glob("*.parquet"))
    assert left == untouched
    assert apply_deletes(spark, path, spark.createDataFrame([("unknown",)], "id string")) == 0
    assert apply_updates(spark, path, patches(spark, ("unknown", {"title_en": "z"}))) == 0


# --- reports -----------------------------------------------------------------


def stamped(spark, *rows):
    return spark.createDataFrame(rows, "id string, ts string, category string, source_name string").select(
        "id", F.col("ts").cast("timestamp").alias("published_at"), "category", "source_name"
    )


def news_rows(spark):
    return stamped(
        spark,
        ("1", "2026-05-04 00:00:00", "AI", "s"),
        ("2", "2026-05-04 23:00:00", "IA", "S"),  # later than now, but today
        ("3", "2026-05-03 23:59:59", "", None),
        ("4", "2026-04-27 12:00:00", None, "s"),  # in the week, on no bar
        ("5", "2026-04-27 11:59:59", "AI", ""),
        ("6", "2026-04-28 00:00:00", "Other", "s"),
        ("7", "2026-05-05 00:00:00", "AI", "s"),  # tomorrow: in the week, on no bar
        ("8", None, "AI", None),
    )


def test_kpis(spark):
    assert tuple(kpis(news_rows(spark), NOW).first()) == (8, 6, 3, 4)
    assert kpis(news_rows(spark), NOW, tz="America/Sao_Paulo").first().today_total == 2
    assert tuple(kpis(news_rows(spark).limit(0), NOW).first()) == (0, 0, 0, 0)
    assert kpis(news_rows(spark), NOW, approximate=True).first().active_sources == 4
    assert active_sources(news_rows(spark)).first()[0] == 4


def test_bars(spark):
    bars = [tuple(r) for r in daily_volume(news_rows(spark), NOW, "pt").select(F.col("day").cast("string"), "name", "count").collect()]
    assert bars == [
        ("2026-04-28", "Ter", 1), ("2026-04-29", "Qua", 0), ("2026-04-30", "Qui", 0),
        ("2026-05-01", "Sex", 0), ("2026-05-02", "Sab", 0), ("2026-05-03", "Dom", 1),
        ("2026-05-04", "Seg", 2),
    ]
    week = week_total(news_rows(spark), NOW).first()[0]
    assert sum(b[2] for b in bars) == 4 < week == 6
    empty = daily_volume(news_rows(spark).limit(0), NOW)
    assert [r["count"] for r in empty.collect()] == [0] * 7


def test_categories(spark):
    got = [tuple(r) for r in category_distribution(news_rows(spark)).collect()]
    assert got == [("AI", 4), ("Other", 3), ("IA", 1)]
    share = category_share(news_rows(spark)).agg(F.sum("share"), F.max("share")).first()
    assert abs(share[0] - 1) < 1e-12 and share[1] == 0.5


def test_latest_and_listing(spark):
    order = ["8", "7", "2", "1", "3", "6", "4", "5"]
    assert [r.id for r in listing(news_rows(spark)).collect()] == order
    assert [r.id for r in latest(news_rows(spark), 3).collect()] == order[:3]
    same = stamped(spark, *[(i, "2026-01-01", "c", "s") for i in "cab"])
    assert [r.id for r in latest(same).collect()] == ["a", "b", "c"]


def test_latest_reads_only_the_days_it_needs(spark, tmp_path):
    path = str(tmp_path / "news")
    for day, urls in {"2026-05-04": "ab", "2026-05-01": "cdef", "2025-01-01": "ghijkl", None: "m"}.items():
        rows = table(spark, *urls).withColumn("published_at", F.lit(day).cast("timestamp"))
        append_news(rows, path)
    news = read_news(spark, path)
    for n, folders in ((2, 2), (3, 2), (4, 3), (7, 3), (8, 4), (13, 4), (20, 4)):
        narrow, full = latest(news, n, now=NOW), latest(news, n)
        assert narrow.collect() == full.collect() and narrow.count() == min(n, 13)
        read = narrow.select("published_date").distinct().count()
        assert read <= folders
    text = plan(latest(news, 3, now=NOW))
    assert "PartitionFilters: [(isnull(published_date" in text and "2026-05-03" in text


def test_edits_of_many_ids(spark, tmp_path):
    path = str(tmp_path / "news")
    append_news(table(spark, *[f"u{i}" for i in range(40)]), path)
    ids = read_news(spark, path).where("source_url not in ('u1', 'u2')").select("id")
    assert apply_deletes(spark, path, materialize(ids, "ids")) == 1
    assert {r.source_url for r in read_news(spark, path).collect()} == {"u1", "u2"}


def test_lookup(spark):
    rows = news_rows(spark).unionByName(news_rows(spark).where("id = '2'"))
    assert get_article(rows, "1").count() == 1
    assert get_article(rows, "2").count() == 0
    assert get_article(rows, "99").count() == 0


def test_language_has_no_fallback(spark):
    rows = small_news(spark).withColumn("title_pt", F.lit(""))
    assert localize(rows, "pt").first().title == ""
    assert localize(rows, "fr").first().title == "a"


# --- plans -------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "news")
    rows = batch(spark, *[f"u{i}" for i in range(50)])
    append_news(publish(rows, spark.createDataFrame([], NEWS), NOW, ["pos"]), path)
    return read_news(spark, path)


def test_plan_of_caps(spark, stored):
    text = plan(cap_per_feed(stored, ("category", "source_name"), ("id",)))
    assert text.count("WindowGroupLimit") == 2


def test_plan_of_latest(spark, stored):
    assert "TakeOrderedAndProject" in plan(latest(stored))


def test_plan_of_time_filters(spark, stored):
    text = plan(week_total(stored, NOW))
    assert "GreaterThanOrEqual(published_at" in text
    assert "ReadSchema: struct<published_at:timestamp>" in text
    bars = plan(daily_volume(stored, NOW))
    assert "LessThan(publis" in bars
    # Folders of other days are not even listed.
    for pruned in (text, bars):
        assert "PartitionFilters: [isnotnull(published_date" in pruned


def test_plan_of_kpis(spark, stored):
    text = plan(kpis(stored, NOW))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<source_name:string,published_at:timestamp>" in text


def test_plan_of_lookup(spark, stored):
    assert "EqualTo(id,x)" in plan(get_article(stored, "x"))


def test_materialized_rows_have_no_lineage(spark):
    kept = materialize(spark.range(10).where("id > 3"), "test")
    assert "Range" not in plan(kept) and kept.count() == 6

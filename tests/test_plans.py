"""Whole runs."""

import json

from pyspark.sql import functions as F

from feedloom.plans.backoffice import editor_list, record
from feedloom.plans.dashboard import dashboard
from feedloom.plans.harvest import HARVEST_ORDER, harvest, harvest_to, rejects
from feedloom.plans.portal import article_page, front_page
from feedloom.plans.publish import publish_payload
from feedloom.sources.catalog import read_catalog
from feedloom.sources.news import read_news

NOW = "2026-05-04 12:00:00"


def rss(title, *items):
    body = "".join(
        f"<item><title>{t}</title><link>{u}</link>"
        + (f"<description>{d}</description>" if d is not None else "")
        + (f"<pubDate>{p}</pubDate>" if p else "")
        + "</item>"
        for t, u, d, p in items
    )
    name = f"<title>{title}</title>" if title else ""
    return f"<rss><channel>{name}{body}</channel></rss>"


RECENT, OLD = "Mon, 04 May 2026 01:00:00 GMT", "Sat, 02 May 2026 01:00:00 GMT"


def client():
    def call(text):
        if "fail" in text:
            raise RuntimeError("no")
        return {"title_pt": "PT " + text, "summary_en": text, "summary_pt": None}

    return call


def inputs(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps({"Dev": ["u1", "gone"], "AI": ["u2", "u3"]}))
    docs = {
        ("Dev", "u1"): rss(
            "One",
            ("old", "l0", "x", OLD),
            ("a", "l1", "&lt;p&gt;fail&lt;/p&gt;", RECENT),
            ("b", "l2", "&lt;p&gt;B &amp;amp; &lt;i&gt;b&lt;/i&gt;&lt;/p&gt;", RECENT),
            ("c", "l3", None, None),
            ("d", "l4", "d", RECENT),
        ),
        ("AI", "u2"): rss(None, ("b", "l2", "again", RECENT)),
        ("AI", "u3"): "<rss><chan",
        ("AI", "not listed"): rss("x", ("n", "ln", "n", RECENT)),
    }
    rows = [(c, u, p) for (c, u), p in docs.items()]
    payloads = spark.createDataFrame(rows, "category string, feed_url string, payload string")
    payloads = payloads.withColumn("fetched_at", F.lit(NOW).cast("timestamp"))
    return payloads, read_catalog(spark, str(path))


def test_harvest(spark, tmp_path):
    payloads, catalog = inputs(spark, tmp_path)
    got = harvest(payloads, catalog, client, NOW).orderBy(*HARVEST_ORDER).collect()
    assert [(r.category, r.source_url, r.source_name) for r in got] == [
        ("Dev", "l2", "One"), ("Dev", "l3", "One"), ("AI", "l2", "Unknown Source")
    ]
    assert got[0].title_en == "b" and got[0].title_pt == "PT B & b" and got[0].summary_pt is None
    # Without a summary the title is the text, and without a date an entry is new.
    assert [(r.feed_url, r.reject) for r in rejects(payloads, catalog, NOW).collect()] == [("u3", "unreadable")]
    assert got[1].summary_en == "c" and str(got[1].entry_published_at) == NOW


def test_from_feeds_to_pages(spark, tmp_path):
    payloads, catalog = inputs(spark, tmp_path)
    payload, news = str(tmp_path / "payload"), str(tmp_path / "news")
    harvest_to(spark, payloads, catalog, client, NOW, payload)
    assert tuple(publish_payload(spark, payload, news, NOW).first()) == (2, 1, 0, 3)
    stored = read_news(spark, news)
    # The URL in two categories goes to the first one in the catalogue.
    assert {(r.source_url, r.category) for r in stored.collect()} == {("l2", "Dev"), ("l3", "Dev")}

    page = front_page(stored, "pt").collect()
    assert {r.title for r in page} == {"PT B & b", "PT c"} and page[0].date == "04 de mai. de 2026"
    one = article_page(stored, page[0].id, "en").first()
    assert one.date == "May 04, 2026 at 12:00 PM"
    assert record(stored, page[0].id, "en").first().date == "May 04, 2026"
    assert article_page(stored, "nothing", "en").count() == 0
    rows = editor_list(stored, "pt").collect()
    assert {(r.date, r.status) for r in rows} == {("04/05/2026", "Publicado")}

    shown = dashboard(stored, NOW)
    assert tuple(shown["kpis"].first()) == (2, 2, 2, 1)
    assert [r["count"] for r in shown["daily"].collect()] == [0, 0, 0, 0, 0, 0, 2]
    assert [tuple(r) for r in shown["categories"].collect()] == [("Dev", 2, 1.0)]

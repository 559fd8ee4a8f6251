"""Catalogues, feed documents and payload files."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.sources.catalog import flatten_catalog, read_catalog
from feedloom.sources.feeds import parse_feeds, read_entries, split_rejects
from feedloom.sources.payload import read_payload, write_payload

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel><title>Feed &amp; Co</title><link>http://a</link>
<item><title>T1</title><link>http://1</link><description><![CDATA[<p>hi</p>]]></description>
<pubDate>Sun, 03 May 2026 14:05:00 GMT</pubDate><guid isPermaLink="false">g</guid></item>
<item><title type="html">T2</title><guid>http://2</guid><description></description>
<content:encoded>full</content:encoded></item>
<item><title>T3</title><guid isPermaLink="false">g3</guid><content:encoded>full</content:encoded></item>
</channel></rss>"""
ONE = "<rss><channel><item><title>only</title><link>l</link></item></channel></rss>"
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel><title>Old</title></channel>
<item><title>R1</title><link>r</link></item></rdf:RDF>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title>
<entry><title type="html">A1</title><link rel="self" href="s"/><link href="h1"/>
<summary type="html">&lt;p&gt;x</summary><published>2026-05-03T14:05:00Z</published></entry>
<entry><title>A2</title><link rel="alternate" href="h2"/><content>c</content>
<updated>2026-05-03T14:05:00Z</updated></entry></feed>"""
EMPTY = "<rss><channel><title>none</title></channel></rss>"
BAD = ["<rss><channel><title>e</title><item><ti", "hello", "", "<html><body/></html>", None]


def payloads(spark):
    docs = [("rss", RSS), ("one", ONE), ("rdf", RDF), ("atom", ATOM), ("empty", EMPTY)]
    docs += [(f"bad{i}", b) for i, b in enumerate(BAD)]
    return spark.createDataFrame(docs, "feed_url string, payload string")


def test_entries_of_all_formats(spark):
    got = {(r.feed_url, r.pos): r for r in parse_feeds(payloads(spark)).collect()}
    assert set(got) == {
        ("rss", 0), ("rss", 1), ("rss", 2), ("one", 0), ("rdf", 0), ("atom", 0), ("atom", 1)
    }
    first = got["rss", 0]
    assert (first.feed_title, first.title, first.link) == ("Feed & Co", "T1", "http://1")
    assert (first.summary, first.published_raw) == ("<p>hi</p>", "Sun, 03 May 2026 14:05:00 GMT")
    # An empty description is kept, an absent one falls back to the content.
    assert (got["rss", 1].link, got["rss", 1].summary) == ("http://2", "")
    assert (got["rss", 2].link, got["rss", 2].summary) == (None, "full")
    assert got["one", 0].feed_title is None and got["one", 0].summary is None
    assert (got["rdf", 0].feed_title, got["rdf", 0].link) == ("Old", "r")
    assert (got["atom", 0].link, got["atom", 0].summary) == ("h1", "<p>x")
    assert (got["atom", 1].link, got["atom", 1].summary, got["atom", 1].published_raw) == ("h2", "c", None)


def test_rejects(spark):
    good, rejects = split_rejects(read_entries(payloads(spark)))
    assert good.count() == 6
    got = {(r.feed_url, r.reject) for r in rejects.collect()}
    assert got == {(f"bad{i}", "unreadable") for i in range(len(BAD))} | {("rss", "incomplete")}


def test_near_xml_is_read(spark):
    text = (
        "\ufeff\n<?xml version='1.0'?><rss><channel><item><title>a&nbsp;&mdash;&eacute; &amp; &#233;</title>"
        "<link>l</link><description><![CDATA[x&nbsp;&lt;&amp;nbsp;]]></description></item></channel></rss>"
    )
    row = parse_feeds(spark.createDataFrame([(text,)], "payload string")).first()
    assert row.title == "a\xa0—é & é" and row.summary == "x\xa0&lt;&amp;nbsp;"


def test_documents_are_parsed_once(spark):
    good, _ = split_rejects(read_entries(payloads(spark)))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") == 1


def test_catalog(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps({"B": ["u1", "u2"], "A": ["u3"], "none": []}, indent=2))
    got = [tuple(r) for r in read_catalog(spark, str(path)).orderBy("category_pos", "feed_pos").collect()]
    assert got == [("B", 0, "u1", 0), ("B", 0, "u2", 1), ("A", 1, "u3", 0)]
    assert read_catalog(spark, str(tmp_path / "missing.json")).count() == 0
    path.write_text('{"B": ["u1"')
    with pytest.raises(Exception, match="MALFORMED"):
        read_catalog(spark, str(path)).collect()
    rows = spark.createDataFrame([('{"B": ["u1"',), ('{"A": ["u"]}',)], "t string")
    assert [r.feed_url for r in flatten_catalog(rows, "t").collect()] == ["u"]


def article(i, **changes):
    names = "category source_name source_url title_en title_pt summary_en summary_pt".split()
    return {**{n: f"{n} {i}" for n in names}, **changes}


def test_payload_array_file(spark, tmp_path):
    items = [article(0, title_pt="não"), article(1, summary_pt=None), article(2)]
    path = tmp_path / "payload.json"
    path.write_text(json.dumps(items, indent=4, ensure_ascii=False))
    rows = read_payload(spark, str(path), array=True).orderBy("payload_row").collect()
    assert [r.source_url for r in rows] == ["source_url 0", "source_url 1", "source_url 2"]
    assert rows[0].title_pt == "não" and rows[1].summary_pt is None
    path.write_text("[]")
    assert read_payload(spark, str(path), array=True).count() == 0
    assert read_payload(spark, str(tmp_path / "missing")).count() == 0


def test_payload_keeps_order_and_nulls(spark, tmp_path):
    path = str(tmp_path / "payload")
    rows = spark.createDataFrame([(n, article(n)) for n in range(500)], "n int, a map<string,string>")
    names = list(article(0))
    rows = rows.select("n", *[F.col("a")[c].alias(c) for c in names]).withColumn(
        "title_pt", F.when(F.col("n") % 2 == 0, F.col("title_pt"))
    )
    write_payload(rows.repartition(8), path, ("n",))
    back = read_payload(spark, path)
    order = [c for c in back.columns if c.startswith("payload_")]
    got = [r.source_url for r in back.orderBy(*order).collect()]
    assert got == [f"source_url {n}" for n in range(500)]
    assert back.where("title_pt is null").count() == 250
    text = "".join(p.read_text() for p in (tmp_path / "payload").glob("part-*"))
    assert text.count('"title_pt":null') == 250
    write_payload(rows.limit(1), path)
    assert read_payload(spark, path).count() == 1

"""Feeds as they are found: broken markup and relative links."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from feedloom.functions.urls import resolve
from feedloom.sources.feeds import parse_feeds, read_entries
from queries.harvest import RFC_BASE, RFC_EXAMPLES

ITEM = "<item><title>t{0}</title><link>http://x/{0}</link><description>d{0}</description></item>"


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, r, b) for i, (r, b) in enumerate(pairs)], "i long, ref string, base string")
    return [r[0] for r in df.select("i", resolve(F.col("ref"), F.col("base")).alias("u")).orderBy("i").select("u").collect()]


def test_the_examples_of_the_rfc(spark):
    examples = {**RFC_EXAMPLES, "": "http://a/b/c/d;p?q"}
    assert len(examples) == 42
    assert resolved(spark, [(r, RFC_BASE) for r in examples]) == list(examples.values())


def test_resolution_against_the_standard_library(spark):
    chance = random.Random(3)
    names = ["a", "b.c", "..", ".", "d;p", "é"]
    pairs = []
    for _ in range(400):
        path = "/".join(chance.choices(names, k=chance.randrange(1, 6)))
        ref = path + chance.choice(["", "?q", "?", "#f", "?q=../x#a?b"])
        pairs.append((ref.lstrip("/"), chance.choice(["http://h/a/b/c?x#y", "http://h", "http://h/", "https://u@h:8/a/b/"])))
    pairs = [(r, b) for r, b in pairs if r and ":" not in r and not r.startswith(("?", "#")) and "?#" not in r and not r.endswith("?")]
    assert resolved(spark, pairs) == [urljoin(b, r) for r, b in pairs]


def test_missing_parts(spark):
    pairs = [(None, "http://h/"), ("a", None), ("a", "no-scheme/x"), ("//h2/p", "http://h/q"), ("mailto:x@y", "http://h/"), (" a ", "http://h/b/")]
    assert resolved(spark, pairs) == [None, "a", "no-scheme/a", "http://h2/p", "mailto:x@y", "http://h/b/a"]


def read(spark, payload, **options):
    df = spark.createDataFrame([("f", "http://feed/x/y", payload)], "feed string, url string, payload string")
    return read_entries(df, keep=["feed"], **options).orderBy(F.asc_nulls_first("pos")).collect()


def test_links_resolve_against_nested_bases(spark):
    rss = '<rss><channel xml:base="/c/">{}</channel></rss>'.format(
        '<item xml:base="i/"><title>a</title><link>l?q</link></item>'
        "<item><title>b</title><link>../up</link></item><item><title>c</title><link>http://own/../x</link></item>"
    )
    assert [r.link for r in read(spark, rss, base="url")] == ["http://feed/c/i/l?q", "http://feed/up", "http://own/../x"]
    assert [r.link for r in read(spark, rss)] == ["/c/i/l?q", "/up", "http://own/../x"]
    atom = '<feed xml:base="http://h/a/"><title>T</title><entry xml:base="b/"><title>e</title><link xml:base="c/" href="d"/></entry><entry><title>f</title><link href="g"/></entry></feed>'
    assert [r.link for r in read(spark, atom, base="url")] == ["http://h/a/b/c/d", "http://h/a/g"]


BROKEN = {
    "cut in an entry": ("<rss><channel><title>T</title>" + ITEM.format(1) + ITEM.format(2) + "<item><title>t3</ti", "cut", ["t1", "t2"]),
    "cut behind an entry": ("<rss><channel><title>T</title>" + ITEM.format(1), "recovered", ["t1"]),
    "stray end tag": ("<rss><channel><title>T</title>" + ITEM.format(1) + "</b></link>" + ITEM.format(2) + "</channel></rss>", "recovered", ["t1", "t2"]),
    "lone ampersand": ("<rss><channel><title>A & B</title><item><title>x & y &amp; z</title><link>http://x/?a=1&b=2</link></item></channel></rss>", "recovered", ["x & y & z"]),
    "open title": ("<rss><channel><title>T</title><item><title>t1<link>http://x/1</link></item>" + ITEM.format(2) + "</channel></rss>", "recovered", ["t1", "t2"]),
    "markup in a text": ("<rss><channel><title>T</title><item><title>t1</title><link>http://x/1</link><description>a<br>b <p>c</description></item></channel></rss>", "recovered", ["t1"]),
    "stray sign": ("<rss><channel><title>T</title><item><title>1 < 2</title><link>http://x/1</link></item></channel></rss>", "recovered", ["1 < 2"]),
    "entry not ended": ("<rss><channel><title>T</title><item><title>t1</title><link>http://x/1</link>" + ITEM.format(2) + "</channel></rss>", "cut", ["t2"]),
    "broken attribute": ('<rss version="2.0><channel><title>T</title>' + ITEM.format(1) + "</channel></rss>", "recovered", ["t1"]),
    "section and comment": ("<rss><channel><title>T</title><!-- <item> --><item><title><![CDATA[a <b> & c]]></title><link>http://x/1</link></item></b></channel></rss>", "recovered", ["a <b> & c"]),
    "atom": ('<feed><title>T</title><entry><title>t1</title><link href="http://x/1"/></entry><entry><title>t2</title><link href="http://x/2"></entry></feed>', "recovered", ["t1", "t2"]),
    "control character": ("<rss><channel><title>T</title><item><title>t\x071</title><link>http://x/1</link></item></channel></rss>", "recovered", ["t1"]),
}


@pytest.mark.parametrize("name", BROKEN)
def test_entries_of_broken_feeds(spark, name):
    payload, reason, titles = BROKEN[name]
    assert [r.reject for r in read(spark, payload)] == ["unreadable"]
    first, *entries = read(spark, payload, recover=True)
    assert (first.reject, first.pos) == (reason, None)
    assert [(r.title, r.reject, r.pos) for r in entries] == [(t, None, i) for i, t in enumerate(titles)]
    assert all(r.link.startswith("http://x/") for r in entries)


def test_texts_with_markup_keep_it(spark):
    _, entry = read(spark, BROKEN["markup in a text"][0], recover=True)
    assert entry.summary == "a<br>b <p>c"


def test_sound_feeds_and_hopeless_ones_are_as_before(spark):
    sound = "<rss><channel><title>T</title>" + ITEM.format(1) + "<item><link>l</link></item></channel></rss>"
    assert read(spark, sound, recover=True) == read(spark, sound)
    for payload in ("no feed", "", None, "<html><body>x</html>", "<rss><channel><title>T</title><item><title>t"):
        assert [r.reject for r in read(spark, payload, recover=True)] == ["unreadable"]
    df = spark.createDataFrame([("f", sound)], "feed string, payload string")
    assert parse_feeds(df).count() == 2


def test_repair_is_linear(spark):
    """A document of some megabytes is read in seconds."""
    payload = "<rss><channel><title>T</title>" + "".join(ITEM.format(i) + "<b>&<" for i in range(30_000))
    rows = read_entries(spark.createDataFrame([(payload,)], "payload string"), recover=True)
    assert rows.where("pos IS NOT NULL").count() == 30_000

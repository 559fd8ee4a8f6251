import datetime as dt

from pyspark.sql import functions as F

from feedloom.llm.asof import asof, intervals
from feedloom.llm.urlfilter import filter_urls, host_of, keys_of


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_keys(spark):
    df = spark.createDataFrame([("HTTPS://u:p@A.b.Example.com:80/x/y/z?q=/w",), ("nonsense",), (None,), ("http://h",)], "url string")
    rows = [r[0] for r in df.select(keys_of(F.col("url"), 3, 1)).collect()]
    assert rows[0] == [
        "url:HTTPS://u:p@A.b.Example.com:80/x/y/z?q=/w", "prefix:a.b.example.com/", "prefix:a.b.example.com/x/",
        "host:a.b.example.com", "domain:example.com", "domain:b.example.com",
    ]
    assert rows[1] == ["url:nonsense"] and rows[2] == [] and rows[3] == ["url:http://h", "host:h"]
    assert df.select(host_of(F.col("url"))).first()[0] == "a.b.example.com"


def test_asof_against_brute_force(spark):
    changes = [("k", day(n * 7 % 31, n % 24), n % 3 != 0) for n in range(60)] + [("j", day(3), True), ("j", day(3), False)]
    rows = [(k, day(n % 40, n % 23), n) for n in range(200) for k in ("k", "j", "none")]
    valid = intervals(spark.createDataFrame(changes, "k string, at timestamp, active boolean"), ["k"], "at", "active")
    out = asof(spark.createDataFrame(rows, "k string, t timestamp, n int"), valid, ["k"], "t", most=2)

    def active(k, t):
        known = [(at, on) for key, at, on in changes if key == k and at <= t]
        return bool(known) and max(known)[1]

    assert sorted((r.k, r.n) for r in out.collect()) == sorted((k, n) for k, t, n in rows if active(k, t))


def test_filter(spark):
    entries = spark.createDataFrame(
        [
            ("bad", "domain", "x.com", False, day(1), True), ("bad", "domain", "x.com", False, day(5), False),
            ("good", "host", "ok.x.com", True, day(2), True), ("bad", "prefix", "ok.x.com/p/", False, day(0), True),
            ("bad", "url", "http://ok.x.com/p/q", False, day(0), False), ("bad", "host", None, False, day(0), True),
            ("also", "domain", "x.com", True, day(0), True),
        ],
        "list string, kind string, value string, allow boolean, listed_at timestamp, active boolean",
    )
    captures = [
        (1, "http://a.x.com/", day(0)), (2, "http://a.x.com/", day(1)), (3, "http://a.x.com/", day(5)),
        (4, "http://ok.x.com/", day(2)), (5, "http://ok.x.com/p/q", day(3)), (6, None, day(1)),
        (7, "http://a.x.com/", None), (2, "http://a.x.com/", day(1)), (8, "http://notx.com", day(2)), (9, "", day(2)),
    ]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("row", "_url", "_at", "key", "rule", "lists")))
    out = filter_urls(df, entries)
    assert set(df.columns) < set(out.columns)
    rows = sorted((r.page_id, r.active_entries, r.rule, r.rule_list, r.blocked) for r in out.collect())
    assert rows[:7] == [
        (1, 1, "domain:x.com", "also", False), (2, 2, "domain:x.com", "bad", True), (2, 2, "domain:x.com", "bad", True),
        (3, 1, "domain:x.com", "also", False), (4, 3, "host:ok.x.com", "good", False),
        (5, 4, "prefix:ok.x.com/p/", "bad", True), (6, 0, None, None, False),
    ]
    assert [r[1:] for r in rows[7:]] == [(0, None, None, False)] * 3
    assert filter_urls(df.limit(0), entries).count() == 0
    assert {r.blocked for r in filter_urls(df, entries.limit(0)).collect()} == {False}

"""Column functions on hand-made edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions.dates import day_spine, entry_date, instant, midnight, parse_feed_date
from feedloom.functions.display import fmt_day, fmt_int, fmt_long, fmt_numeric, fmt_short, weekday
from feedloom.functions.response import (
    contract_violations,
    field_or,
    has_answer,
    parse_response,
    with_answers,
)
from feedloom.functions.text import decode_entities, html_to_text, render_prompt, to_request, truncate


def apply(spark, function, values, result="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = rows.select("i", function(F.col("v")).cast(result).alias("r")).collect()
    return [r.r for r in sorted(out, key=lambda r: r.i)]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Sun, 03 May 2026 14:05:00 GMT", "2026-05-03 14:05:00"),
        ("Sun, 03 May 2026 14:05:00 +0200", "2026-05-03 12:05:00"),
        ("Sun, 3 May 2026 14:05:00 +0000", "2026-05-03 14:05:00"),
        ("3 May 2026 14:05:00 GMT", "2026-05-03 14:05:00"),
        ("Sun, 03 May 2026 14:05 GMT", "2026-05-03 14:05:00"),
        # A zone name is a fixed offset, also in summer.
        ("Sun, 03 May 2026 14:05:00 EST", "2026-05-03 19:05:00"),
        ("Sun, 03 May 2026 14:05:00 PDT", "2026-05-03 21:05:00"),
        ("2026-05-03T14:05:00Z", "2026-05-03 14:05:00"),
        ("2026-05-03T14:05:00+02:00", "2026-05-03 12:05:00"),
        ("  2026-05-03T14:05:00.250Z ", "2026-05-03 14:05:00.25"),
        ("Thu, 01 Jan 04 19:48:21 GMT", "2004-01-01 19:48:21"),
        ("Fri, 01 Jan 99 19:48:21 GMT", "1999-01-01 19:48:21"),
        ("Thu, 01 Jan 2004", "2004-01-01 00:00:00"),
        ("Sun,03 May 2026 14:05:00+0200", "2026-05-03 12:05:00"),
        ("Sun, 03 may 2026  4:05:00  -02:30", "2026-05-03 06:35:00"),
        ("Thursday, 03 September 2026 14:05:00 gmt", "2026-09-03 14:05:00"),
        ("Sun, 03 May 2026 14:05:00 CEST", "2026-05-03 14:05:00"),
        ("Sun May  3 14:05:00 2026", "2026-05-03 14:05:00"),
        ("2026-05-03T14:05Z", "2026-05-03 14:05:00"),
        ("2026-05-03", "2026-05-03 00:00:00"),
        ("Sun, 31 Feb 2026 14:05:00 GMT", None),
        ("Sun, 03 Foo 2026 14:05:00 GMT", None),
        ("Sun, 03 May 2026 25:05:00 GMT", None),
        ("2026-13-45T00:00:00Z", None),
        ("garbage", None),
        ("14:05", None),
        ("", None),
        (None, None),
    ],
)
def test_feed_dates(spark, raw, expected):
    assert apply(spark, parse_feed_date, [raw]) == [expected]


def test_entry_without_a_date_is_new(spark):
    now = "2026-05-04 00:00:00"
    got = apply(spark, lambda c: entry_date(c, now), ["garbage", None])
    assert got == [now, now]


def test_html_to_text(spark):
    cases = {
        "<p>one <b>two</b></p><p> three </p>": "one two three",
        "a<!--x-->b": "a b",
        "a<!-- <script> -->b": "a b",
        '<script>var t="</p>";</script>x': "x",
        "<style>p{}</style >x<template><p>no</p></template>": "x",
        "<script>never closed": "",
        '<script src="a.js"/>kept': "kept",
        "<ruby>kanji<rt>ka</rt></ruby>": "kanji",
        '<a title="a > b" href=\'c>d\'>link</a>': "link",
        "<p don't>it's</p>": "it's",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&amp;lt;": "&lt;",
        "&lt;b&gt;": "<b>",
        "&nbsp;x ": "x",
        "a\n  b<br>\n c": "a\n  b c",
        "<!DOCTYPE html><?php x ?><html>t</html>": "t",
        "cut <a hre": "cut",
        "plain": "plain",
        "": "",
        " \n ": "",
    }
    assert apply(spark, html_to_text, list(cases)) == list(cases.values())
    assert apply(spark, html_to_text, [None]) == [None]


def test_long_runs_of_space_and_brackets_are_no_trap(spark):
    long = "x" + " " * 200_000 + "y<b>z" + "<a " * 200_000
    (got,) = apply(spark, html_to_text, [long])
    assert got == "x" + " " * 200_000 + "y z"


def test_entities(spark):
    cases = {
        "&copy; &copy &hellip;&eacute;": "© © …é",
        "&#233;&#xE9;&#XE9": "ééé",
        "&#128512;": "😀",
        "&#150;": "–",
        "&#55296;&#99999999999;": "��",
        "&unknown; &am": "&unknown &am",
        "R&D & co && x&": "R&D & co && x&",
        "&rarr;&NotEqualTilde;": "→≂̸",
    }
    assert apply(spark, decode_entities, list(cases)) == list(cases.values())


def test_truncate_counts_code_points(spark):
    values = ["x" * 2499, "x" * 2500, "x" * 2501, "x" * 2499 + "😀y"]
    assert [len(v) for v in apply(spark, truncate, values)] == [2499, 2500, 2500, 2500]
    assert apply(spark, truncate, values)[3].endswith("😀")


def test_request(spark):
    (request,) = apply(spark, lambda c: to_request(render_prompt(c)), ['say "hi"'])
    body = json.loads(request)
    assert body["model"] == "llama3:latest" and body["format"] == "json" and body["stream"] is False
    assert body["prompt"].endswith('Article Excerpt:\nsay "hi"\n')


def envelope(inner):
    return json.dumps({"model": "m", "response": inner, "context": [1, 2], "done": True})


RESPONSES = [
    (envelope('{"title_en":"a","title_pt":null}'), {"title_en": "a", "title_pt": None}),
    (envelope(' {"title_en":"a"}\n'), {"title_en": "a"}),
    (envelope("{}"), {}),
    (envelope("not json"), None),
    (envelope('{"title_en":"a"'), None),
    (envelope(""), None),
    (envelope('{"a":"1"} trailing'), None),
    (envelope('{"a":"1"}{"b":"2"}'), None),
    (envelope('{"a":"1"},{"b":"2"}'), None),
    (envelope("{'a':'1'}"), None),
    (envelope('```json\n{"a":"1"}\n```'), None),
    (envelope('{"a":"1"} ]'), None),
    (envelope('{"a":"x\ny"}'), None),
    (envelope("null"), None),
    (envelope("[]"), None),
    (envelope('""'), None),
    (envelope("0"), None),
    (envelope("[1,2]"), None),
    (envelope("true"), None),
    (envelope('{"title_en":5}'), {"title_en": "5"}),
    (envelope('{"a":"1","a":"2"}'), {"a": "2"}),
    ('{"model":"m"}', None),
    ('{"response":null}', None),
    ('{"response":{"title_en":"a"}}', None),
    ('{"response":"{}"', None),
    ("null", None),
    ("", None),
    (None, None),
]


def test_response_shapes(spark):
    raw = [r for r, _ in RESPONSES]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, v string")
    got = {r.i: r.m for r in rows.select("i", parse_response(F.col("v")).alias("m")).collect()}
    assert [got[i] for i in range(len(raw))] == [m for _, m in RESPONSES]
    kept = {r.i for r in with_answers(rows, "v").collect()}
    assert kept == {i for i, (_, m) in enumerate(RESPONSES) if m}


def test_absent_null_and_empty_keys_differ(spark):
    rows = spark.createDataFrame(
        [(0, {}), (1, {"k": None}), (2, {"k": ""}), (3, {"k": "v"}), (4, None)],
        "i int, m map<string,string>",
    )
    m = F.col("m")
    out = rows.select("i", field_or(m, "k", F.lit("d")).alias("r"), has_answer(m).alias("a"))
    got = {r.i: (r.r, r.a) for r in out.collect()}
    assert got == {
        0: ("d", False), 1: (None, True), 2: ("", True), 3: ("v", True), 4: ("d", False)
    }


def test_contract(spark):
    good = dict(title_en="a", title_pt="b", summary_en="c", summary_pt="d")
    cases = [
        (json.dumps(good), []),
        (json.dumps({**good, "x": "y"}), ["extra:x"]),
        (json.dumps({"title_en": "a 🚀", "title_pt": "b", "summary_en": "c"}, ensure_ascii=False),
         ["emoji", "missing:summary_pt"]),
        ("```json\n" + json.dumps(good) + "\n```", ["fence", "not_json"]),
        ("no", ["not_json"]),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = rows.select("i", contract_violations(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in cases]


def test_display(spark):
    ts = instant("2026-05-03 14:05:09")
    shown = spark.range(1).select(
        fmt_short(ts, "en"), fmt_short(ts, "pt"), fmt_long(ts, "en"), fmt_long(ts, "pt"),
        fmt_day(ts, "en"), fmt_day(ts, "pt"), fmt_numeric(ts, "fr"), fmt_numeric(ts, "pt"),
        weekday(F.to_date(ts), "en"), weekday(F.to_date(ts), "pt"),
        weekday(F.date_sub(F.to_date(ts), 1), "pt"),
        fmt_int(F.lit(1234567)), fmt_int(F.lit(None).cast("int")),
        fmt_short(F.lit(None).cast("timestamp"), "pt"),
    ).first()
    assert list(shown) == [
        "May 03, 2026", "03 de mai. de 2026", "May 03, 2026 at 02:05 PM",
        "03 de maio de 2026 às 14:05", "May 03, 2026", "03 de maio de 2026", "5/3/2026",
        "03/05/2026", "Sun", "Dom", "Sab", "1,234,567", "0", None,
    ]


def test_day_bounds(spark):
    now = "2026-03-01 01:30:00"
    row = spark.range(1).select(
        midnight(now).cast("string"),
        midnight(now, "America/Sao_Paulo").cast("string"),
        day_spine(now, 7).cast("array<string>"),
    ).first()
    assert row[0] == "2026-03-01 00:00:00"
    assert row[1] == "2026-02-28 03:00:00"
    assert row[2] == [f"2026-02-{d}" for d in range(23, 29)] + ["2026-03-01"]

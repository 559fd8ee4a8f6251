"""Text and response functions against models built on the standard library, on random input."""

import hashlib
import json
import random
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from feedloom.functions.fixed import PROMPT_HEAD, PROMPT_TAIL
from feedloom.functions.response import parse_response
from feedloom.functions.text import html_to_text

HIDDEN = {"script", "style", "template", "rt", "rp"}


class TextNodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.current, self.inside = [], "", []

    def flush(self, *_):
        if self.current and not self.inside:
            self.nodes.append(self.current)
        self.current = ""

    handle_startendtag = handle_comment = handle_decl = handle_pi = unknown_decl = flush

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in HIDDEN:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        self.current += data

    def handle_entityref(self, name):
        self.current += html5.get(name + ";", "&" + name)

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        try:
            self.current += bytes([code]).decode("cp1252")
        except ValueError:
            self.current += chr(code)


def html_model(markup):
    parser = TextNodes()
    parser.feed(markup)
    parser.close()
    parser.flush()
    return " ".join(text for text in (node.strip() for node in parser.nodes) if text)


HTML_PARTS = [
    "word", " ", "\n", "a b", "é", "\xa0", "1<2", " < ", " > ", "& ", "&&", "don't",
    "&amp;", "&lt;", "&eacute;", "&nbsp;", "&#233;", "&#x41;", "&#150;", "&foo;", "&copy ",
    "<p>", "</p>", "<br/>", "<b>", "</b>", '<div class="x">', "</div>", "</ p>", "<input disabled>",
    "<a href='u>v' title=\"q\">", "</a>", "<img src=x alt='a>b' />", "<p data-x=1>", '<h1\n id="a">',
    "<p title=don't>", "<a b = 'c>d' >", "<!-- c > d -->", "<!DOCTYPE html>", "<?php x ?>",
    "<script>var a='<p>';</script>", "<SCRIPT type=x>if(a<b){}</Script >", "<style>p>q{}</style>",
    "<template>t<b>u</b></template>", "<ruby>k<rt>r</rt></ruby>", "<scripty>", "<style/>",
]


def test_html_to_text_equals_a_parser(spark):
    pick = random.Random(7)
    cases = [
        "".join(pick.choice(HTML_PARTS) for _ in range(pick.randint(1, 14))) + " end"
        for _ in range(3000)
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, h string").repartition(8)
    got = {r.i: r.t for r in rows.select("i", html_to_text(F.col("h")).alias("t")).collect()}
    assert [(c, got[i]) for i, c in enumerate(cases)] == [(c, html_model(c)) for c in cases]


def test_pages_equal_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", html_to_text(F.col("html")).alias("t")).collect():
        assert row.t == html_model(row.html)


def response_model(envelope):
    try:
        answer = json.loads(json.loads(envelope)["response"])
    except (ValueError, TypeError, KeyError):
        return None
    if not isinstance(answer, dict):
        return None

    def text(value):
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    return {key: text(value) for key, value in answer.items()}


JSON_PARTS = [
    "{", "}", "[", "]", '"a"', ":", ",", "null", "true", "1", "1.5", '""', '"q\\"q"', " ", "\n",
    "'s'", "//c", "01", '"é"', "{}", "[]", '"a":"1"', '"b":null', "NaN", "+1", '"\t"', '"\\x"',
    "\\", "tru", '"un',
]
VALUES = ["x", None, "", 5, 1.5, True, {"n": 1}, [1, "a"], 'q"uote', "new\nline", "😀", "]", "}", " {"]


def test_response_parsing_equals_a_parser(spark):
    pick = random.Random(7)

    def damaged(text, parts):
        where, kind = pick.randint(0, len(text)), pick.random()
        if kind < 0.2:
            return text[:where]
        return text[:where] + pick.choice(parts) + text[where:] if kind < 0.5 else text

    cases = []
    for _ in range(4000):
        keys = pick.sample(["title_en", "title_pt", "s", "é"], pick.randint(0, 4))
        answer = {key: pick.choice(VALUES) for key in keys}
        text = json.dumps(answer, ensure_ascii=False, indent=pick.choice([None, 2]))
        if pick.random() < 0.3:
            text = "".join(pick.choice(JSON_PARTS) for _ in range(pick.randint(0, 9)))
        # Escapes would be cut into half a surrogate pair, which a Spark string cannot hold.
        envelope = json.dumps(
            {"model": "m", "response": damaged(text, JSON_PARTS), "done": True}, ensure_ascii=False
        )
        cases.append(damaged(envelope, JSON_PARTS) if pick.random() < 0.1 else envelope)
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, e string").repartition(8)
    got = {r.i: r.m for r in rows.select("i", parse_response(F.col("e")).alias("m")).collect()}
    assert [(c, got[i]) for i, c in enumerate(cases)] == [(c, response_model(c)) for c in cases]
    assert 500 < sum(m is not None for m in got.values()) < 3500


def test_the_request_text_is_pinned():
    assert hashlib.md5((PROMPT_HEAD + "|" + PROMPT_TAIL).encode()).hexdigest() == "1818115f34cc1bb857f9956c2638624d"

"""Catalogue, feed documents, filters, text, responses, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.dates import entry_date, instant, latest_instant
from feedloom.functions.fixed import MODEL, PROMPT_HEAD, PROMPT_TAIL
from feedloom.functions.response import (
    contract_violations,
    field_or,
    has_answer,
    with_answers,
)
from feedloom.functions.text import html_to_text, render_prompt, to_request, truncate
from feedloom.operators.enrich import enrich, enrich_capped, json_client
from feedloom.operators.harvest import (
    cap_per_feed,
    content,
    enriched_only,
    harvest_report,
    recent,
    source_name,
    to_article,
)
from feedloom.operators.skew import union_batches
from feedloom.plans.harvest import as_request, harvest, harvest_by_model, harvest_to
from feedloom.session import materialize, scratch_path
from feedloom.sources.answers import AnswerStore
from feedloom.sources.catalog import flatten_catalog
from feedloom.sources.feeds import parse_feeds, read_entries, split_rejects
from feedloom.sources.payload import read_payload
from queries import query
from queries.inputs import (
    ISSUE,
    SQL_ANSWERED,
    SQL_STAMP,
    escaped,
    extractive_client,
    extractive_sender,
    feed_documents,
    rare_client,
    stamp,
    table,
)


@query(
    """
    SELECT doc_id, lang AS category, CAST(0 AS BIGINT) AS category_pos, source AS feed_url,
           CAST(0 AS BIGINT) AS feed_pos FROM documents
    UNION ALL
    SELECT doc_id, lang, 0, source || '/' || doc_id, 1 FROM documents
    UNION ALL
    SELECT doc_id, 'all', 1, source, 0 FROM documents
    """
)
def catalog_flatten(spark, sf_dir):
    listed = F.create_map(
        F.col("lang"),
        F.array("source", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))),
        F.lit("all"),
        F.array("source"),
    )
    catalogs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(listed).alias("json"))
    return flatten_catalog(catalogs, "json", keep=["doc_id"]).select(
        "doc_id",
        "category",
        F.col("category_pos").cast("bigint").alias("category_pos"),
        "feed_url",
        F.col("feed_pos").cast("bigint").alias("feed_pos"),
    )


# XML readers drop white space at the ends of an element's text.
_TRIMMED = r"regexp_replace(text, '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g')"


@query(
    rf"""
    SELECT lang AS category, source AS feed_url, doc_id // {ISSUE} AS issue, source AS feed_title,
           row_number() OVER (PARTITION BY lang, source, doc_id // {ISSUE} ORDER BY doc_id) - 1 AS pos,
           'doc ' || doc_id AS title, 'http://feed.example/' || doc_id AS link,
           {_TRIMMED} AS summary
    FROM documents
    """
)
def feed_xml_items(spark, sf_dir):
    return parse_feeds(feed_documents(spark, sf_dir)).select(
        "category",
        "feed_url",
        "issue",
        "feed_title",
        F.col("pos").cast("bigint").alias("pos"),
        "title",
        "link",
        "summary",
    )


# The base and the references of RFC 3986, sections 5.4.1 and 5.4.2, with what
# each resolves to. The empty reference is left out, since a link cannot be empty.
RFC_BASE = "http://a/b/c/d;p?q"
RFC_EXAMPLES = {
    "g:h": "g:h",
    "g": "http://a/b/c/g",
    "./g": "http://a/b/c/g",
    "g/": "http://a/b/c/g/",
    "/g": "http://a/g",
    "//g": "http://g",
    "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x",
    "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s",
    ".": "http://a/b/c/",
    "./": "http://a/b/c/",
    "..": "http://a/b/",
    "../": "http://a/b/",
    "../g": "http://a/b/g",
    "../..": "http://a/",
    "../../": "http://a/",
    "../../g": "http://a/g",
    "../../../g": "http://a/g",
    "../../../../g": "http://a/g",
    "/./g": "http://a/g",
    "/../g": "http://a/g",
    "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x",
    "http:g": "http:g",
}


@query(
    f"""
    WITH examples AS (SELECT unnest({list(RFC_EXAMPLES)!r}) AS ref, unnest({list(RFC_EXAMPLES.values())!r}) AS url,
                             unnest(range({len(RFC_EXAMPLES)})) AS i)
    SELECT doc_id, ref, url AS link FROM documents JOIN examples ON i = doc_id % {len(RFC_EXAMPLES)}
    """
)
def feed_links(spark, sf_dir):
    """Each item's link is one of the RFC's references, its base nested in two elements."""
    references = F.array(*[F.lit(r) for r in RFC_EXAMPLES])
    ref = F.get(references, (F.col("doc_id") % len(RFC_EXAMPLES)).cast("int"))
    landed = feed_documents(spark, sf_dir, link=ref, title=F.concat_ws(" ", "doc_id", ref), description=F.lit("d"))
    outer, inner = '<rss xml:base="x/y" version', '<channel xml:base="../b/c/d;p?q">'
    based = F.replace(F.replace("payload", F.lit("<rss version"), F.lit(outer)), F.lit("<channel>"), F.lit(inner))
    entries = parse_feeds(landed.withColumns({"payload": based, "url": F.lit("http://a/index.xml")}), base="url")
    named = F.split(F.col("title"), " ", 2)
    return entries.select(
        F.get(named, F.lit(0)).cast("bigint").alias("doc_id"), F.get(named, F.lit(1)).alias("ref"), "link"
    )


@query(
    f"""
    WITH items AS (SELECT lang AS category, source AS feed_url, doc_id // {ISSUE} AS issue, doc_id,
                          row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang, source, doc_id // {ISSUE}) AS n
                   FROM documents WINDOW w AS (PARTITION BY lang, source, doc_id // {ISSUE} ORDER BY doc_id)),
    kept AS (SELECT * FROM items WHERE issue % 4 <> 0 OR pos < n - 1)
    SELECT category, feed_url, issue, NULL AS reason, pos, 'a & b ' || doc_id AS title FROM kept
    UNION ALL
    SELECT category, feed_url, issue,
           CASE WHEN issue % 4 = 0 THEN CASE WHEN max(n) > 1 THEN 'cut' ELSE 'unreadable' END ELSE 'recovered' END, -1, NULL
    FROM items WHERE issue % 4 <> 3 GROUP BY category, feed_url, issue
    """
)
def feed_recovered(spark, sf_dir):
    """Of four issues one is cut in its last entry, one has stray tags, one lone signs; one is sound."""
    title = F.concat(F.lit("a & b "), F.col("doc_id").cast("string"))
    landed = feed_documents(spark, sf_dir, title=title)
    at = F.col("issue") % 4
    payload = F.col("payload")
    stray = F.replace(payload, F.lit("</item>"), F.lit("</b></item></p><br>"))
    lone = F.replace(payload, F.lit("a &amp; b"), F.lit("a & b"))
    broken = (
        F.when(at == 0, F.substring(payload, F.lit(1), F.length(payload) - 30))
        .when(at == 1, stray)
        .when(at == 2, lone)
        .otherwise(payload)
    )
    entries = read_entries(landed.withColumn("payload", broken), recover=True)
    return entries.select(
        "category", "feed_url", "issue", F.col("reject").alias("reason"), F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), "title"
    )


@query(
    f"""
    WITH items AS (
        SELECT lang AS category, source AS feed_url, doc_id // {ISSUE} AS issue, doc_id
        FROM documents
    )
    SELECT DISTINCT 'unreadable' AS reason, category, feed_url, issue, CAST(NULL AS VARCHAR) AS link
    FROM items WHERE issue % 3 = 0
    UNION ALL
    SELECT 'incomplete', category, feed_url, issue, 'http://feed.example/' || doc_id
    FROM items WHERE issue % 3 <> 0 AND doc_id % 7 = 0
    """
)
def feed_rejects(spark, sf_dir):
    title = F.when(F.col("doc_id") % 7 != 0, F.lit("title"))
    cut = F.when(
        F.col("issue") % 3 == 0, F.substring("payload", F.lit(1), F.length("payload") - 10)
    ).otherwise(F.col("payload"))
    landed = feed_documents(spark, sf_dir, title=title).withColumn("payload", cut)
    _, rejects = split_rejects(read_entries(landed))
    return rejects.select(
        F.col("reject").alias("reason"), "category", "feed_url", "issue", "link"
    )


@query(
    f"""
    SELECT event_id, event_type, strftime(ts, {SQL_STAMP}) AS ts FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
    """
)
def recent_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = latest_instant(events, "ts")
    return recent(events, "ts", now).select("event_id", "event_type", stamp("ts").alias("ts"))


@query(
    f"""
    SELECT event_id, strftime(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0
                              THEN (SELECT max(ts) FROM events)
                              ELSE date_trunc('second', ts) END, {SQL_STAMP}) AS entry_date
    FROM events
    """
)
def entry_date_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = latest_instant(events, "ts")
    rfc = "EEE, d MMM yyyy HH:mm:ss"
    form = F.col("event_id") % 5
    raw = (
        F.when(F.col("event_id") % 7 == 0, None)
        .when(F.col("event_id") % 11 == 0, F.lit("yesterday"))
        .when(form == 0, F.concat(F.date_format("ts", rfc), F.lit(" GMT")))
        .when(
            form == 1,
            F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), rfc), F.lit(" +0200")),
        )
        .when(
            form == 2,
            F.concat(F.date_format(F.col("ts") - F.expr("INTERVAL 5 HOURS"), rfc), F.lit(" EST")),
        )
        .when(form == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(
            F.concat(
                F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                F.lit("-03:00"),
            )
        )
    )
    return events.select("event_id", stamp(entry_date(raw, now)).alias("entry_date"))


@query(
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' ELSE text END
               AS content,
           CASE WHEN doc_id % 5 = 0 THEN 'Unknown Source' ELSE source END AS source_name
    FROM documents
    """
)
def content_fallback(spark, sf_dir):
    summary = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("text"))
    feed_title = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        content(summary, F.col("source")).alias("content"),
        source_name(feed_title).alias("source_name"),
    )


_SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _sql_html_text(html: str) -> str:
    steps = html
    for pattern in (
        r"(?is)<script\b.*?</script\s*>",
        r"(?is)<style\b.*?</style\s*>",
        r"(?s)<!--.*?-->",
        r"(?s)<[!/a-zA-Z][^>]*>",
    ):
        steps = f"regexp_replace({steps}, '{pattern}', chr(1), 'g')"
    for entity, char in (
        ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "),
        ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"),
    ):
        steps = f"regexp_replace({steps}, '{entity}', '{char}', 'g')"
    stripped = (
        f"list_transform(string_split({steps}, chr(1)), "
        f"lambda x: regexp_replace(x, '^[{_SQL_SPACE}]+|[{_SQL_SPACE}]+$', '', 'g'))"
    )
    return f"array_to_string(list_filter({stripped}, lambda x: x <> ''), ' ')"


@query(
    f"""
    SELECT page_id, text, substr(text, 1, 2500) AS clean
    FROM (SELECT page_id, {_sql_html_text('html')} AS text FROM pages)
    """
)
def html_text(spark, sf_dir):
    text = table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return text.withColumn("clean", truncate(F.col("text")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"""
    SELECT doc_id, md5(prompt) AS prompt_md5, md5(prompt) AS sent_md5, '{MODEL}' AS model,
           'json' AS format, 'false' AS stream
    FROM (SELECT doc_id, {_quoted(PROMPT_HEAD)} || text || {_quoted(PROMPT_TAIL)} AS prompt
          FROM documents)
    """
)
def prompt_digest(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select(
        "doc_id", render_prompt(F.col("text")).alias("prompt")
    )
    sent = F.from_json("request", "model string, prompt string, format string, stream string")
    return (
        prompts.withColumn("request", to_request(F.col("prompt")))
        .select("doc_id", "prompt", sent.alias("sent"))
        .select(
            "doc_id",
            F.md5("prompt").alias("prompt_md5"),
            F.md5("sent.prompt").alias("sent_md5"),
            "sent.model",
            "sent.format",
            "sent.stream",
        )
    )


def _responses(spark, sf_dir):
    """Envelopes around good and bad answers, by document number."""
    shape = F.col("doc_id") % 12
    good = F.to_json(
        F.struct(
            F.col("source").alias("title_en"),
            F.col("lang").alias("title_pt"),
            F.col("text").alias("summary_en"),
            F.md5("text").alias("summary_pt"),
        )
    )
    two = F.to_json(F.struct(F.col("source").alias("title_en"), F.col("text").alias("summary_en")))
    inner = (
        F.when(shape == 0, "{}")
        .when(shape == 1, "not json")
        .when(shape == 2, F.substring(good, F.lit(1), F.length(good) - 2))
        .when(shape == 3, F.concat(good, F.lit(" and more")))
        .when(shape == 4, "{'title_en':'x'}")
        .when(shape == 5, '{"title_en":"x","title_pt":null}')
        .when(shape == 6, two)
        .when(shape == 8, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(shape == 9, "[1,2]")
        .when(shape == 10, F.concat(good, good))
        .otherwise(good)
    )
    with_answer = F.to_json(F.struct(F.lit("m").alias("model"), inner.alias("response")))
    envelope = F.when(shape == 7, '{"model":"m"}').otherwise(with_answer)
    return table(spark, sf_dir, "documents").select("*", envelope.alias("envelope"))


@query(
    """
    SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN 'x' ELSE source END AS title_en,
           CASE doc_id % 12 WHEN 5 THEN NULL WHEN 6 THEN '' ELSE lang END AS title_pt,
           CASE WHEN doc_id % 12 = 5 THEN '' ELSE text END AS summary_en,
           CASE WHEN doc_id % 12 IN (5, 6) THEN '' ELSE md5(text) END AS summary_pt
    FROM documents WHERE doc_id % 12 IN (5, 6, 11)
    """
)
def response_parse(spark, sf_dir):
    answer = F.col("answer")
    return with_answers(_responses(spark, sf_dir), "envelope").select(
        "doc_id",
        field_or(answer, "title_en", F.col("text")).alias("title_en"),
        field_or(answer, "title_pt", F.lit("")).alias("title_pt"),
        field_or(answer, "summary_en", F.lit("")).alias("summary_en"),
        field_or(answer, "summary_pt", F.lit("")).alias("summary_pt"),
    )


@query(
    """
    SELECT doc_id, CASE doc_id % 6
        WHEN 0 THEN ''
        WHEN 1 THEN 'missing:summary_en,missing:summary_pt'
        WHEN 2 THEN 'extra:note'
        WHEN 3 THEN 'emoji'
        WHEN 4 THEN 'fence,not_json'
        ELSE 'not_json' END AS violations
    FROM documents
    """
)
def contract_check(spark, sf_dir):
    shape = F.col("doc_id") % 6
    base = [
        F.col("source").alias("title_en"),
        F.col("lang").alias("title_pt"),
        F.md5("text").alias("summary_en"),
        F.md5("lang").alias("summary_pt"),
    ]
    good = F.to_json(F.struct(*base))
    text = (
        F.when(shape == 1, F.to_json(F.struct(*base[:2])))
        .when(shape == 2, F.to_json(F.struct(*base, F.lit("n").alias("note"))))
        .when(shape == 3, F.replace(good, F.lit('"title_en":"'), F.lit('"title_en":"🚀 ')))
        .when(shape == 4, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(shape == 5, F.concat(good, F.lit(" done")))
        .otherwise(good)
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(contract_violations(text), ",").alias("violations")
    )


@query(
    """
    SELECT doc_id, lang AS category,
           CASE WHEN doc_id % 5 = 0 THEN 'Unknown Source' ELSE source END AS source_name,
           md5(text) AS source_url,
           CASE WHEN doc_id % 3 = 0 THEN split_part(text, '.', 1) ELSE source END AS title_en,
           CASE WHEN doc_id % 3 = 1 THEN NULL ELSE '' END AS title_pt,
           text AS summary_en, '' AS summary_pt
    FROM documents
    """
)
def article_records(spark, sf_dir):
    rest = F.struct(F.lit("summary_en").alias("key"), F.col("text").alias("value"))

    def pair(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    form = F.col("doc_id") % 3
    pairs = (
        F.when(form == 0, F.array(rest))
        .when(
            form == 1,
            F.array(
                pair("title_en", F.col("source")),
                pair("title_pt", F.lit(None).cast("string")),
                rest,
            ),
        )
        .otherwise(F.array(pair("title_en", F.col("source")), rest))
    )
    entries = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("feed_title"),
        F.md5("text").alias("link"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.map_from_entries(pairs).alias("answer"),
    )
    return to_article(entries, keep=["doc_id"])


@query(
    """
    SELECT doc_id, lang, source, source AS title_en FROM documents WHERE doc_id % 3 <> 0
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2
    """,
    name="cap_per_feed",
)
def capped_articles(spark, sf_dir):
    # Every third document failed: it has no answer, or an empty one.
    failed = F.when(F.col("doc_id") % 2 == 0, F.create_map().cast("map<string,string>"))
    answer = F.when(F.col("doc_id") % 3 == 0, failed).otherwise(
        F.create_map(F.lit("title_en"), F.col("source"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", answer.alias("answer"))
    capped = cap_per_feed(enriched_only(rows), feed=("lang", "source"), order=("doc_id",))
    return capped.select("doc_id", "lang", "source", F.col("answer.title_en").alias("title_en"))


@query(
    f"""
    SELECT doc_id, {SQL_ANSWERED.format('text')} AS answered,
           CASE WHEN {SQL_ANSWERED.format('text')} THEN split_part(text, '.', 1) END AS title_en,
           CASE WHEN {SQL_ANSWERED.format('text')} THEN CAST(length(text) AS VARCHAR) END AS summary_pt
    FROM documents
    """
)
def enrich_rows(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    answer = F.col("answer")
    return enrich(documents, extractive_client(), text="text").select(
        "doc_id",
        has_answer(answer).alias("answered"),
        answer["title_en"].alias("title_en"),
        answer["summary_pt"].alias("summary_pt"),
    )


def _mute_client():
    """A model that answers nothing: what is known without it was stored."""

    def connect():
        return lambda text: None

    return connect


@query(
    f"""
    SELECT 'rows' AS run, doc_id, CASE WHEN {SQL_ANSWERED.format('text')} THEN split_part(text, '.', 1) END AS title_en
    FROM documents
    UNION ALL
    SELECT 'capped', doc_id, split_part(text, '.', 1) FROM documents WHERE {SQL_ANSWERED.format('text')}
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2
    """
)
def enrich_cached(spark, sf_dir):
    """A first run asks a model and stores its answers; later runs ask one that knows nothing."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    answers = AnswerStore(scratch_path(spark, "answers"))
    enrich(documents, extractive_client(), text="text", answers=answers)
    rows = enrich(documents, _mute_client(), text="text", answers=answers)
    capped = enrich_capped(
        documents, _mute_client(), feed=("lang", "source"), order=("doc_id",), text="text", answers=answers
    )
    title = F.col("answer.title_en").alias("title_en")
    return rows.select(F.lit("rows").alias("run"), "doc_id", title).unionByName(
        capped.select(F.lit("capped").alias("run"), "doc_id", title)
    )


@query(
    f"""
    SELECT doc_id, lang, source, split_part(text, '.', 1) AS title_en
    FROM documents WHERE {SQL_ANSWERED.format('text')}
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2
    """,
    name="enrich_capped",
)
def capped_enrichment(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    answered = enrich_capped(
        documents, extractive_client(), feed=("lang", "source"), order=("doc_id",), text="text"
    )
    return answered.select("doc_id", "lang", "source", F.col("answer.title_en").alias("title_en"))


# An entry is its number modulo 48 hours old, so half of them are recent.
_NOW = "2024-01-31 00:00:00"


@query(
    rf"""
    WITH entries AS (
        SELECT doc_id, lang, source,
               substr(regexp_replace(text, '^[{_SQL_SPACE}]+|[{_SQL_SPACE}]+$', '', 'g'), 1, 2500) AS clean
        FROM documents WHERE doc_id % 48 <= 24
    )
    SELECT lang AS category, source || '/' || (doc_id // 100) AS feed_url, source AS source_name,
           'http://feed.example/' || doc_id AS source_url,
           split_part(clean, '.', 1) AS title_en, 'pt ' || split_part(clean, '.', 1) AS title_pt,
           clean AS summary_en, CAST(length(clean) AS VARCHAR) AS summary_pt
    FROM entries WHERE {SQL_ANSWERED.format('clean')}
    QUALIFY row_number() OVER (PARTITION BY lang, source, doc_id // 100 ORDER BY doc_id) <= 2
    """
)
def harvest_articles(spark, sf_dir):
    """A whole harvest run: RSS documents in, at most two articles per feed out.

    Every issue is a feed of its own, as a run sees one document per feed.
    """
    age = F.make_interval(hours=(F.col("doc_id") % 48).cast("int"))
    published = F.concat(
        F.date_format(instant(_NOW) - age, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")
    )
    fragment = F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>"))
    landed = feed_documents(spark, sf_dir, description=fragment, published=published)
    own = F.concat_ws("/", "feed_url", F.col("issue").cast("string"))
    payloads = landed.withColumns({"fetched_at": F.timestamp_seconds("issue"), "feed_url": own})
    payloads = payloads.drop("issue")
    catalog = payloads.select(
        "category", "feed_url", F.lit(0).alias("category_pos"), F.lit(0).alias("feed_pos")
    )
    return harvest(payloads, catalog, extractive_client(), _NOW).select(
        "category",
        "feed_url",
        "source_name",
        "source_url",
        "title_en",
        "title_pt",
        "summary_en",
        "summary_pt",
    )


@query(
    rf"""
    WITH newest AS (
        SELECT *, substr(regexp_replace(text, '^[{_SQL_SPACE}]+|[{_SQL_SPACE}]+$', '', 'g'), 1, 2500) AS clean
        FROM documents
        QUALIFY doc_id // 100 = max(doc_id // 100) OVER (PARTITION BY lang, source)
    )
    SELECT lang AS category, source AS feed_url, 'http://feed.example/' || doc_id AS source_url,
           split_part(clean, '.', 1) AS title_en
    FROM newest WHERE {SQL_ANSWERED.format('clean')}
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2
    """
)
def harvest_newest(spark, sf_dir):
    """A run over feeds with documents of many times, listed twice, with undated entries.

    The model is one that takes request bodies and returns envelopes.
    """
    fragment = F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>"))
    landed = feed_documents(spark, sf_dir, description=fragment)
    payloads = landed.withColumn("fetched_at", F.timestamp_seconds("issue")).drop("issue")
    feeds = payloads.select("category", "feed_url").distinct()
    twice = F.explode(F.array(F.lit(1), F.lit(0))).alias("feed_pos")
    catalog = feeds.select("*", F.lit(0).alias("category_pos"), twice)
    articles = harvest_by_model(payloads, catalog, extractive_sender(), _NOW)
    return articles.select("category", "feed_url", "source_url", "title_en")


@query(
    rf"""
    WITH newest AS (
        SELECT *, substr(regexp_replace(text, '^[{_SQL_SPACE}]+|[{_SQL_SPACE}]+$', '', 'g'), 1, 2500) AS clean
        FROM documents
        QUALIFY doc_id // 100 = max(doc_id // 100) OVER (PARTITION BY lang, source) AND doc_id // 100 >= 3
    )
    SELECT * FROM (
        SELECT 'article' AS kind, lang AS category, source AS feed, 'http://feed.example/' || doc_id AS link,
               split_part(clean, '.', 1) AS title
        FROM newest WHERE {SQL_ANSWERED.format('clean')} AND doc_id % 10 <> 0
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2)
    UNION ALL
    SELECT 'incomplete', lang, source, 'http://feed.example/' || doc_id, NULL FROM newest WHERE doc_id % 10 = 0
    """
)
def harvest_stored(spark, sf_dir):
    """A run into files: its articles and what it passed over, of documents landed since the third issue.

    Every tenth entry has no title. A second run, whose model answers nothing, gives the same.
    """
    fragment = F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>"))
    title = F.when(F.col("doc_id") % 10 != 0, F.lit("titled"))
    landed = feed_documents(spark, sf_dir, description=fragment, title=title)
    payloads = materialize(landed.withColumn("fetched_at", F.timestamp_seconds("issue")).drop("issue"), "payloads")
    feeds = payloads.select("category", "feed_url").distinct()
    catalog = feeds.select("*", F.lit(0).alias("category_pos"), F.lit(0).alias("feed_pos"))
    path, answers = scratch_path(spark, "payload"), AnswerStore(scratch_path(spark, "answers"))
    for client in (json_client(extractive_sender()), _mute_client()):
        harvest_to(
            spark, payloads, catalog, client, _NOW, path,
            fetched_since=F.timestamp_seconds(F.lit(3)), wrap=as_request(), answers=answers,
        )
    rejects = spark.read.schema("category string, feed_url string, link string, title string, reject string").json(f"{path}-rejects")
    return read_payload(spark, path).select(
        F.lit("article").alias("kind"), "category", F.col("source_name").alias("feed"),
        F.col("source_url").alias("link"), F.col("title_en").alias("title"),
    ).unionByName(rejects.select(F.col("reject").alias("kind"), "category", F.col("feed_url").alias("feed"), "link", "title"))


@query(
    """
    SELECT doc_id, lang FROM documents WHERE length(text) % 97 = 0
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 2
    """
)
def enrich_capped_deep(spark, sf_dir):
    """Feeds whose answers are rare, so that they lie behind the first rounds."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = enrich_capped(
        documents, rare_client(), feed=("lang",), order=("doc_id",), text="text", blocks=(8, 64)
    )
    return found.select("doc_id", "lang")


@query(
    """
    SELECT lang AS category, source AS feed_url,
           CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level,
           CAST(count(*) AS BIGINT) AS articles
    FROM documents GROUP BY ROLLUP (lang, source)
    """
)
def harvest_rollup(spark, sf_dir):
    articles = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("category"), F.col("source").alias("feed_url")
    )
    return harvest_report(articles)


@query("SELECT doc_id, lang, source, text FROM documents UNION ALL SELECT doc_id, lang, source, text FROM documents WHERE lang = 'en'", name="union_batches")
def union_batches_by_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    english = documents.where(F.col("lang") == "en")
    # The batches list their columns in different orders.
    others = documents.where(F.col("lang") != "en").select("text", "source", "lang", "doc_id")
    return union_batches(english, others, english)


@query(
    """
    SELECT lang AS category, source || '/' || (doc_id // 100) AS feed_url, 'atom ' || source AS feed_title,
           CAST(row_number() OVER (PARTITION BY lang, source, doc_id // 100 ORDER BY doc_id) - 1 AS INT) AS pos,
           'doc ' || doc_id AS title, 'http://feed.example/' || doc_id AS link,
           CASE WHEN doc_id % 3 = 0 THEN '2024-01-01T00:00:00Z' END AS published_raw
    FROM documents
    """
)
def feed_atom_items(spark, sf_dir):
    """Atom documents with several links per entry, some entries with an old kind of date."""

    def link(kind: str, suffix: str):
        start = f'<link rel="alternate" type="{kind}" href="http://feed.example/'
        return F.concat(F.lit(start), F.col("doc_id").cast("string"), F.lit(f'{suffix}"/>'))

    issued = F.when(F.col("doc_id") % 3 == 0, F.lit("<issued>2024-01-01T00:00:00Z</issued>")).otherwise("")
    item = F.concat(
        F.lit("<entry><title>doc "),
        F.col("doc_id").cast("string"),
        F.lit("</title>"),
        link("text/html", ""),
        link("application/json", ".json"),
        issued,
        F.lit("</entry>"),
    )
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.floor(F.col("doc_id") / ISSUE).alias("issue"), item.alias("item")
    )
    payloads = (
        documents.groupBy("lang", "source", "issue")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
        .select(
            F.col("lang").alias("category"),
            F.concat_ws("/", "source", F.col("issue").cast("string")).alias("feed_url"),
            F.concat(
                F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>atom '),
                F.col("source"),
                F.lit("</title>"),
                F.array_join(F.col("items.item"), ""),
                F.lit("</feed>"),
            ).alias("payload"),
        )
    )
    return parse_feeds(payloads).select(
        "category", "feed_url", "feed_title", "pos", "title", "link", "published_raw"
    )

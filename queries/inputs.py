"""The given tables, and the shapes the operators expect derived from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.fixed import PROMPT_HEAD, PROMPT_TAIL

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# DuckDB's form of STAMP.
SQL_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

# The DuckDB form of `news_view`.
SQL_NEWS = """
    SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, e.event_type AS category,
           d.source AS source_name, md5(d.text) AS source_url,
           split_part(d.text, '.', 1) AS title_en,
           'pt ' || split_part(d.text, '.', 1) AS title_pt,
           d.text AS summary_en, md5('pt' || d.text) AS summary_pt,
           e.ts AS published_at
    FROM documents d JOIN events e ON e.event_id = d.doc_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, STAMP)


def news_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news rows, published when the event of the same number was.

    Copies of a text share their ``source_url``. ``doc_id`` stays as the order.
    """
    documents = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events")
    title = F.split_part("text", F.lit("."), F.lit(1))
    return documents.join(events, documents["doc_id"] == events["event_id"]).select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.col("event_type").alias("category"),
        F.col("source").alias("source_name"),
        F.md5("text").alias("source_url"),
        title.alias("title_en"),
        F.concat(F.lit("pt "), title).alias("title_pt"),
        F.col("text").alias("summary_en"),
        F.md5(F.concat(F.lit("pt"), "text")).alias("summary_pt"),
        F.col("ts").cast("timestamp").alias("published_at"),
    )


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


ISSUE = 100


def feed_documents(
    spark: SparkSession,
    sf_dir: str,
    description: Column | None = None,
    title: Column | None = None,
    published: Column | None = None,
    link: Column | None = None,
) -> DataFrame:
    """RSS documents of the texts: one per language, source and ``issue``.

    An issue covers ``ISSUE`` consecutive document numbers, so no RSS document has
    more than ``ISSUE`` items, however large the table or one source is.
    """
    description = F.col("text") if description is None else description
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string")) if title is None else title
    link = F.concat(F.lit("http://feed.example/"), F.col("doc_id").cast("string")) if link is None else link

    def element(name: str, value: Column) -> Column:
        text = F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))
        return F.coalesce(text, F.lit(""))

    parts = [element("title", title), element("link", link), element("description", description)]
    if published is not None:
        parts.append(element("pubDate", published))
    item = F.concat(F.lit("<item>"), *parts, F.lit("</item>"))
    issue = F.floor(F.col("doc_id") / ISSUE)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", issue.alias("issue"), item.alias("item"))
        .groupBy("lang", "source", "issue")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
        .select(
            F.col("lang").alias("category"),
            F.col("source").alias("feed_url"),
            "issue",
            F.concat(
                F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'),
                escaped(F.col("source")),
                F.lit("</title>"),
                F.array_join(F.col("items.item"), ""),
                F.lit("</channel></rss>"),
            ).alias("payload"),
        )
    )


def extractive_client(fail_every: int = 5, empty_every: int = 7):
    """A deterministic stand-in for a model.

    The title is the first sentence and the summary is the text. Texts whose
    length is a multiple of ``fail_every`` raise, multiples of ``empty_every`` get
    an empty answer.
    """

    def connect():
        def call(text):
            if len(text) % fail_every == 0:
                raise ValueError("no answer")
            if len(text) % empty_every == 0:
                return {}
            title = text.split(".")[0]
            return {
                "title_en": title,
                "title_pt": "pt " + title,
                "summary_en": text,
                "summary_pt": str(len(text)),
            }

        return call

    return connect


def extractive_sender():
    """:func:`extractive_client` as a model that takes request bodies and sends envelopes."""

    def connect():
        call = extractive_client()()

        def send(body):
            prompt = json.loads(body)["prompt"]
            text = prompt.removeprefix(PROMPT_HEAD).removesuffix(PROMPT_TAIL)
            return json.dumps({"response": json.dumps(call(text))})

        return send

    return connect


def rare_client():
    """A model that answers texts whose length is a multiple of 97."""

    def connect():
        return lambda text: {"title_en": "found"} if len(text) % 97 == 0 else None

    return connect


SQL_ANSWERED = "length({0}) % 5 <> 0 AND length({0}) % 7 <> 0"

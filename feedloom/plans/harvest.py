"""Harvest: landed feed documents to article records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import Instant, entry_date, instant, like, recent_cutoff
from feedloom.functions.fixed import MODEL
from feedloom.functions.once import with_once
from feedloom.functions.text import html_to_text, render_prompt, to_request, truncate
from feedloom.operators.enrich import Client, enrich_capped, json_client
from feedloom.operators.harvest import content, first_rows, recent, to_article
from feedloom.operators.skew import join_by_key
from feedloom.session import materialize
from feedloom.sources.answers import AnswerStore
from feedloom.sources.feeds import read_entries, split_rejects
from feedloom.sources.payload import write_payload

# Position of an article in a run: catalogue order, then document, then entry.
HARVEST_ORDER = ("category_pos", "feed_pos", "fetched_at", "pos")


_FEED = ["category", "feed_url"]


def current_documents(
    payloads: DataFrame, catalog: DataFrame, now: Instant, fetched_since: Instant | None = None
) -> DataFrame:
    """What a run sees: the newest document of each feed of the catalogue, up to ``now``.

    A feed that is listed twice counts where it is first. Of two documents fetched at
    once the lesser text is taken. ``fetched_since`` bounds how old a document may be and
    lets the scan skip older ones. A map task sends one document per feed.
    """
    bounded = payloads.where(F.col("fetched_at") <= like(payloads, "fetched_at", instant(now)))
    if fetched_since is not None:
        since = like(payloads, "fetched_at", instant(fetched_since))
        bounded = bounded.where(F.col("fetched_at") >= since)
    newest = first_rows(bounded, _FEED, [F.desc("fetched_at"), "payload"], 1)
    listed = first_rows(catalog, _FEED, ["category_pos", "feed_pos"], 1)
    return join_by_key(newest, listed, _FEED, "inner", ["fetched_at"])


def _read(documents: DataFrame) -> DataFrame:
    """Entries as feeds are found: broken ones are repaired, links resolved from the feed's URL."""
    return read_entries(documents, recover=True, base="feed_url")


def _entries(
    payloads: DataFrame, catalog: DataFrame, now: Instant, fetched_since: Instant | None
) -> tuple[DataFrame, DataFrame]:
    documents = current_documents(payloads, catalog, now, fetched_since)
    return split_rejects(_read(documents))


def _dated(entries: DataFrame, now: Instant) -> DataFrame:
    return with_once(entries, "entry_published_at", entry_date(F.col("published_raw"), now))


def candidates(
    payloads: DataFrame, catalog: DataFrame, now: Instant, fetched_since: Instant | None = None
) -> DataFrame:
    """Recent, complete entries of the current documents."""
    entries, _ = _entries(payloads, catalog, now, fetched_since)
    return recent(_dated(entries, now), "entry_published_at", now).drop("published_raw")


def rejects(
    payloads: DataFrame, catalog: DataFrame, now: Instant, fetched_since: Instant | None = None
) -> DataFrame:
    """Documents and entries a run passes over, with the reason in ``reject``.

    Documents that had to be repaired are among them, as ``recovered`` or ``cut``; the
    entries that could be told are used.
    """
    return _entries(payloads, catalog, now, fetched_since)[1]


def _asked(found: DataFrame, client: Client, wrap: Callable[[Column], Column], answers: AnswerStore | None) -> DataFrame:
    """Articles from stored candidates."""
    text = wrap(truncate(html_to_text(content(F.col("summary"), F.col("title")))))
    answered = enrich_capped(found, client, order=("pos",), text=text, answers=answers)
    return to_article(answered, keep=["feed_url", "entry_published_at", *HARVEST_ORDER])


def harvest(
    payloads: DataFrame,
    catalog: DataFrame,
    client: Client,
    now: Instant,
    fetched_since: Instant | None = None,
    wrap: Callable[[Column], Column] = lambda text: text,
    answers: AnswerStore | None = None,
) -> DataFrame:
    """Article records of one run, with :data:`HARVEST_ORDER`.

    The client gets clean text of bounded length, or what ``wrap`` makes of it. Markup is
    only cleaned for entries it is asked about, which is why the cleaning is passed as an
    expression instead of being a column of the candidates. Documents are parsed once:
    the candidates are stored before the first round of questions. What ``answers`` has is
    not asked for again, in this run or a later one.
    """
    found = materialize(candidates(payloads, catalog, now, fetched_since), "candidates")
    return _asked(found, client, wrap, answers)


def as_request(model: str = MODEL) -> Callable[[Column], Column]:
    """A clean text as the body of a request to ``model``."""
    return lambda text: to_request(render_prompt(text), model)


def harvest_by_model(
    payloads: DataFrame,
    catalog: DataFrame,
    send: Callable[[], Callable[[str], str]],
    now: Instant,
    model: str = MODEL,
    fetched_since: Instant | None = None,
    answers: AnswerStore | None = None,
) -> DataFrame:
    """:func:`harvest` with a function that sends a request body and returns an envelope.

    Requests are rendered where the text is cleaned. An envelope that cannot be decoded,
    or whose answer is no object, is a failure of that row and uses up no quota.
    """
    return harvest(payloads, catalog, json_client(send), now, fetched_since, as_request(model), answers)


def harvest_to(
    spark: SparkSession,
    payloads: DataFrame,
    catalog: DataFrame,
    client: Client,
    now: Instant,
    path: str,
    fetched_since: Instant | None = None,
    rejects: str | None = None,
    wrap: Callable[[Column], Column] = lambda text: text,
    answers: AnswerStore | None = None,
) -> DataFrame:
    """Write a run's payload file and what it passed over, and return the articles.

    Documents are parsed once for both: their recent entries, and the documents and entries
    that are rejected, are stored before the first question. Rejected ones go to
    ``rejects``, by default beside the payload, as JSON lines with their reason. With
    ``fetched_since`` documents that landed before are not read. For a model that takes
    request bodies pass ``json_client(send)`` and ``as_request(model)``.
    """
    read = _read(current_documents(payloads, catalog, now, fetched_since))
    due = F.col("entry_published_at") >= recent_cutoff(now)
    parsed = materialize(_dated(read, now).where(F.col("reject").isNotNull() | due), "entries")
    good, passed_over = split_rejects(parsed)
    reported = ("category", "feed_url", "fetched_at", "pos", "title", "link", "reject")
    passed_over.select(*reported).write.mode("overwrite").json(rejects or f"{path.rstrip('/')}-rejects")
    articles = materialize(_asked(good.drop("published_raw"), client, wrap, answers), "articles")
    write_payload(articles, path, HARVEST_ORDER)
    return articles

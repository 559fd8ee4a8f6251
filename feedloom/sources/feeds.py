"""Feed documents (RSS 2.0, RSS 1.0, Atom) to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.once import with_once
from feedloom.functions.repair import repaired
from feedloom.functions.text import xml_entities_only
from feedloom.functions.urls import has_scheme, resolve
from feedloom.schema import FEED_XML


_ENTRY = "struct<title:string, link:string, summary:string, published_raw:string, _bases:array<string>>"
_SHOWN = f"struct<pos:int, col:{_ENTRY}, why:string>"


def _readable(payload: Column) -> Column:
    """The payload without what feeds contain and XML readers stumble over."""
    return xml_entities_only(F.btrim(payload, F.lit("\ufeff \t\r\n")))


def _rss_entry(item: Column) -> Column:
    # A guid stands in for the link unless it says that it is not one, and the
    # full content for a description that is absent (not for an empty one).
    permalink = F.when(
        F.coalesce(F.lower(item["guid"]["_isPermaLink"]), F.lit("true")) == "true",
        item["guid"]["_VALUE"],
    )
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(item["link"], permalink).alias("link"),
        F.coalesce(item["description"], item["content:encoded"]).alias("summary"),
        item["pubDate"].alias("published_raw"),
        F.array(item["_xml:base"]).alias("_bases"),
    )


def _atom_entry(entry: Column) -> Column:
    # Only `published`, or `issued` in old feeds, dates an entry; `updated` does not. A
    # link without a type is taken for a page.
    alternate = F.filter(
        entry["link"],
        lambda l: (F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
        & F.lower(F.coalesce(l["_type"], F.lit("text/html"))).isin("text/html", "application/xhtml+xml"),
    )
    return F.struct(
        entry["title"].alias("title"),
        F.try_element_at(alternate, F.lit(-1))["_href"].alias("link"),
        F.coalesce(entry["summary"], entry["content"]).alias("summary"),
        F.coalesce(entry["published"], entry["issued"]).alias("published_raw"),
        F.array(entry["_xml:base"], F.try_element_at(alternate, F.lit(-1))["_xml:base"]).alias("_bases"),
    )


def _in_base(base: Column, nested: Column) -> Column:
    """A base URL after the ``xml:base`` attributes nested within it, from the outside in."""
    return F.aggregate(
        F.filter(nested, lambda b: b.isNotNull()),
        base,
        lambda outer, inner: F.when(outer.isNull(), inner).otherwise(resolve(inner, outer)),
    )


def read_entries(
    payloads: DataFrame, keep: list[str] | None = None, recover: bool = False, base: str | None = None
) -> DataFrame:
    """Entries of every document in ``payload``, numbered from 0, with a ``reject`` reason.

    ``reject`` is ``unreadable`` on the one row of a document that is no XML, broken
    XML or not a feed; ``incomplete`` on an entry without a title or a link; and
    NULL on a good entry. A readable document without entries has no row. One bad
    document does not affect the others, and each is parsed once.

    With ``recover`` the entries of an unreadable document that can be told are read from
    what :func:`feedloom.functions.repair.repaired` makes of it. It has a row without a
    position besides, with the reason ``recovered``, or ``cut`` if an entry did not end.

    Relative links are resolved against ``xml:base`` attributes, nested ones included, and
    these against the URL in the column ``base``, where the document came from.

    ``keep`` names the columns carried along, by default all but the payload.
    """
    keep = [c for c in payloads.columns if c != "payload"] if keep is None else list(keep)
    doc = F.col("_doc")

    def unreadable(doc: Column) -> Column:
        parts = [doc[name].isNotNull() for name in ("channel", "item", "entry", "title")]
        return doc.isNull() | doc["_corrupt_record"].isNotNull() | ~F.greatest(*parts)

    reason = F.when(unreadable(doc), "unreadable")
    read = with_once(
        payloads.withColumn("_base", F.lit(None).cast("string") if base is None else F.col(base)),
        "_doc", F.from_xml(_readable(F.col("payload")), FEED_XML), [*keep, "_base", "payload"],
    )
    if recover:
        # Only what could not be read is repaired and read again.
        read = with_once(read, "_made", F.when(unreadable(doc), repaired(_readable(F.col("payload")))))
        read = with_once(read, "_again", F.from_xml("_made.xml", FEED_XML))
        again = unreadable(doc) & F.col("_again").isNotNull() & ~unreadable(F.col("_again"))
        reason = F.when(again, F.when(F.col("_made.lost") > 0, "cut").otherwise("recovered")).otherwise(reason)
        read = with_once(read.withColumn("_reason", reason), "_doc", F.when(again, F.col("_again")).otherwise(doc), [*keep, "_base", "_reason"])
    else:
        read = read.select(*keep, "_base", "_doc", reason.alias("_reason"))
    entries = F.coalesce(
        F.transform(doc["channel"]["item"], _rss_entry),
        F.transform(doc["item"], _rss_entry),
        F.transform(doc["entry"], _atom_entry),
    )
    # The document's own row, if there is something to say of it, stands before its entries.
    nothing = F.lit(None).cast(_ENTRY)
    entries = F.transform(entries, lambda e, i: F.struct(i.alias("pos"), e.alias("col"), F.lit(None).cast("string").alias("why")))
    told = F.when(F.col("_reason").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("pos"), nothing.alias("col"), F.col("_reason").alias("why"))))
    shown = F.when(F.col("_reason") == "unreadable", told).otherwise(
        F.concat(F.coalesce(told, F.array().cast(f"array<{_SHOWN}>")), F.coalesce(entries, F.array().cast(f"array<{_SHOWN}>")))
    )
    reject = F.coalesce(
        F.col("_row.why"), F.when(F.col("_row.col.title").isNull() | F.col("_row.col.link").isNull(), "incomplete")
    )
    bases = F.concat(F.array(doc["_xml:base"], doc["channel"]["_xml:base"]), F.col("_row.col._bases"))
    link = F.col("_row.col.link")
    absolute = F.when(link.isNull() | has_scheme(F.trim(link)), link).otherwise(resolve(link, _in_base(F.col("_base"), bases)))
    return read.select(
        *keep, "_base", F.coalesce(doc["channel"]["title"], doc["title"]).alias("feed_title"), "_doc", F.explode(shown).alias("_row")
    ).select(
        *keep, "feed_title", F.col("_row.pos").alias("pos"), F.col("_row.col.title").alias("title"), absolute.alias("link"),
        F.col("_row.col.summary").alias("summary"), F.col("_row.col.published_raw").alias("published_raw"), reject.alias("reject"),
    )


def parse_feeds(
    payloads: DataFrame, keep: list[str] | None = None, recover: bool = False, base: str | None = None
) -> DataFrame:
    """The entries of the readable documents; see :func:`read_entries`."""
    entries = read_entries(payloads, keep, recover, base)
    readable = F.col("reject").isNull() | (F.col("reject") == "incomplete")
    return entries.where(readable).drop("reject")


def split_rejects(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows of :func:`read_entries`, and those with a reason to reject them."""
    rejected = F.col("reject").isNotNull()
    return entries.where(~rejected).drop("reject"), entries.where(rejected)

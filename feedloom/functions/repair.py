"""Feeds that are no XML, made into XML that holds the entries that can be told.

A fixed number of regular expressions passes over a document once each; nothing looks back
farther than a tag. Tags that feeds do not have become text, as do stray ``<`` and ``&``;
elements of a text that are left open are closed where the next tag begins, and end tags of
elements that are not open go. What remains is cut at the entries, and a new document is made
of its title and of the entries that end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.once import let

# Elements of RSS and Atom that hold an entry's text, and those around them.
_TEXTS = "title|link|description|content:encoded|guid|pubDate|summary|content|published|issued"
_ENTRIES = "item|entry"
_AROUND = f"{_ENTRIES}|channel|rss|feed|rdf:RDF"

# One token: a section that is text as it is, what is no text at all, a tag, a stray sign.
_TOKEN = (
    r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<![^>]*+(?:>|\z)"
    r"|</?[A-Za-z][^<>]*+>|<|[^<]++"
)
_KNOWN = rf"\A</?(?:{_TEXTS}|{_AROUND})(?:[\s/][^<>]*)?>\z"
_ATTRIBUTES = r"""(?:\s+[\w:.\-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?"""
# Signs that no XML text contains stand for the parts of an element that is whole.
_OPEN, _END = "\x02", "\x03"


def _as_text(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _token(token: Column) -> Column:
    """A token as it goes into the repaired document."""
    lone = F.regexp_replace(token, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);)", "&amp;")
    sound = token.rlike(rf"\A<[/\w:.\-]+{_ATTRIBUTES}>\z")
    name = F.regexp_extract(token, r"\A<(/?[\w:.\-]+)", 1)
    # A tag whose attributes are broken has none.
    tag = F.when(sound, lone).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
    return (
        F.when(token.startswith("<![CDATA["), _as_text(F.regexp_replace(token, r"\A<!\[CDATA\[|\]\]>\z", "")))
        .when(token.rlike(r"\A<[!?]"), F.lit(""))
        .when(token.rlike(_KNOWN), tag)
        .when(token.startswith("<"), _as_text(token))
        .otherwise(F.replace(lone, F.lit(">"), F.lit("&gt;")))
    )


def repaired(payload: Column) -> Column:
    """``(xml, lost)``: well-formed XML with the entries that end, and how many did not.

    ``xml`` is NULL if there is no entry that ends.
    """
    plain = F.regexp_replace(payload, "[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    tokens = F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))
    joined = F.array_join(F.transform(tokens, _token), "")
    # Whole elements of a text, empty ones, those left open; then their lone end tags go.
    whole = F.regexp_replace(joined, rf"<((?:{_TEXTS})\b[^<>]*(?<!/))>([^<]*+)</(?:{_TEXTS})\s*>", f"{_OPEN}$1{_END}$2{_END}")
    empty = F.regexp_replace(whole, rf"<((?:{_TEXTS})\b[^<>]*?)\s*/>", f"{_OPEN}$1{_END}{_END}")
    closed = F.regexp_replace(empty, rf"<((?:{_TEXTS})\b[^<>]*+)>([^<{_OPEN}]*+)", f"{_OPEN}$1{_END}$2{_END}")
    strict = F.regexp_replace(closed, rf"</(?:{_TEXTS})\s*>", "")
    elements = F.regexp_replace(strict, rf"{_OPEN}([\w:.\-]+)([^{_END}]*+){_END}([^{_END}]*+){_END}", "<$1$2>$3</$1>")
    return let(F.split(elements, rf"(?=<(?:{_ENTRIES})\b)"), _document)


def _document(parts: Column) -> Column:
    head, rest = F.get(parts, F.lit(0)), F.slice(parts, 2, F.size(parts))
    entry = rf"(?s)\A(<({_ENTRIES})\b[^<>]*>)(.*?)</(?:{_ENTRIES})\s*>.*\z"
    ended = F.filter(rest, lambda part: part.rlike(entry))
    # Nothing but elements of a text within an entry.
    inside = F.transform(
        ended,
        lambda part: F.concat(
            F.regexp_replace(part, entry, "$1"),
            F.regexp_replace(F.regexp_replace(part, entry, "$3"), rf"</?(?:{_AROUND})\b[^<>]*>", ""),
            F.regexp_replace(part, entry, "</$2>"),
        ),
    )
    atom = F.size(F.filter(ended, lambda part: part.startswith("<entry"))) > 0
    title = F.regexp_extract(head, r"<title\b[^<>]*>[^<]*</title>", 0)
    spaces = 'xmlns:content="urn:content" xmlns:rdf="urn:rdf" xmlns:xlink="urn:xlink"'
    base = F.concat(F.lit(" "), F.regexp_extract(head, r"""xml:base\s*=\s*(?:"[^"<]*"|'[^'<]*')""", 0))

    def around(opening: str, closing: str) -> Column:
        return F.concat(F.lit(f"<{opening} {spaces}"), base, F.lit(">"), title, F.array_join(inside, ""), F.lit(closing))

    rss = F.concat(F.lit(f"<rss {spaces}><channel"), base, F.lit(">"), title, F.array_join(inside, ""), F.lit("</channel></rss>"))
    xml = F.when(F.size(ended) > 0, F.when(atom, around("feed", "</feed>")).otherwise(rss))
    return F.struct(xml.alias("xml"), (F.size(rest) - F.size(ended)).alias("lost"))

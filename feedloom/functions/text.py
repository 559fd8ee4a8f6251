"""HTML to text, truncation and request building."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.fixed import CONTENT_CHARS, MODEL, PROMPT_HEAD, PROMPT_TAIL
from feedloom.functions.once import let

_BREAK = "\x01"

# One left-to-right pass over everything that is not text: comments, elements
# whose content is never shown, end tags and declarations, start tags with
# quoted attribute values. What is not closed runs to the end of the text, as in
# a browser, and possessive repetition never goes back: both keep it linear.
_MARKUP = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|(script|style|template|rt|rp)(?:\s[^>]*+)?(?<!/)>.*?(?:</\1\s*>|\z)"
    r"|[/!?][^>]*+(?:>|\z)"
    r"|[a-z][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|)[^>=]*+)*+(?:>|\z))"
)

# All characters of the Basic Multilingual Plane that Unicode calls white space,
# and the four ASCII separators.
_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())

# Looked up first; the full table is a linear search.
_FREQUENT = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "mdash", "ndash",
             "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "eacute", "atilde", "ccedil")


def _entity_map(names) -> Column:
    table = {name: html.entities.html5[name + ";"] for name in names}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numeric(name: Column) -> Column:
    """Character of ``#233`` or ``#xE9``; 128-159 are read as windows-1252."""
    legacy = {}
    for byte in range(128, 160):
        try:
            legacy[str(byte)] = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    remap = F.from_json(F.lit(json.dumps(legacy)), "map<string,string>")
    digits = F.regexp_replace(name, r"\A#[xX]?", "")
    decimal = F.when(name.rlike(r"\A#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)

    def character(code: Column) -> Column:
        valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        scalar = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        remapped = F.try_element_at(remap, code.cast("string"))
        return F.coalesce(remapped, F.when(valid, scalar), F.lit("\ufffd"))

    return let(decimal.try_cast("bigint"), character)


def _replace_references(text: Column, character: Callable[[Column, Column], Column]) -> Column:
    """Replace each ``&name`` or ``&name;`` by ``character(name, reference)``.

    ``name`` is ``#233``, ``#xE9`` or a word, and ``reference`` the text as it stands.
    """
    pattern = r"\A(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)"

    def named(part: Column, name: Column) -> Column:
        end = F.length(name)
        end = end + F.when(F.substring(part, end + 1, F.lit(1)) == ";", 1).otherwise(0)
        reference = F.concat(F.lit("&"), F.substring(part, F.lit(1), end))
        return F.when(name == "", F.concat(F.lit("&"), part)).otherwise(
            F.concat(character(name, reference), F.substring(part, end + 1, F.length(part)))
        )

    def piece(part: Column) -> Column:
        return let(F.regexp_extract(part, pattern, 1), lambda name: named(part, name))

    def replaced(t: Column) -> Column:
        parts = F.split(t, "&")
        pieces = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(piece(part)))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return let(text, replaced)


def _named_character(name: Column) -> Column:
    everything = _entity_map(n[:-1] for n in html.entities.html5 if n.endswith(";"))
    return F.coalesce(
        F.try_element_at(_entity_map(_FREQUENT), name), F.try_element_at(everything, name)
    )


def decode_entities(text: Column) -> Column:
    """Replace character references in one pass, so ``&amp;lt;`` gives ``&lt;``.

    The semicolon is optional. An unknown name stays, without its semicolon.
    """

    def character(name: Column, reference: Column) -> Column:
        return F.when(name.startswith("#"), _numeric(name)).otherwise(
            F.coalesce(_named_character(name), F.concat(F.lit("&"), name))
        )

    return _replace_references(text, character)


def xml_entities_only(text: Column) -> Column:
    """Replace HTML's named references that XML does not know, such as ``&nbsp;``.

    XML's own five and numeric references stay for the XML reader.
    """

    def character(name: Column, reference: Column) -> Column:
        own = name.isin("amp", "lt", "gt", "quot", "apos") | name.startswith("#")
        return F.when(own, reference).otherwise(F.coalesce(_named_character(name), reference))

    foreign = text.rlike("&(?!(?:amp|lt|gt|quot|apos);)[a-zA-Z]")
    return F.when(foreign, _replace_references(text, character)).otherwise(text)


def html_to_text(markup: Column) -> Column:
    """Text nodes of an HTML fragment, each stripped, joined by one space.

    Scripts, styles, templates, ruby annotations, comments and declarations are
    not text.
    """
    nodes = F.split(decode_entities(F.regexp_replace(markup, _MARKUP, _BREAK)), _BREAK)
    stripped = F.transform(nodes, lambda node: F.btrim(node, F.lit(_SPACE)))
    return F.array_join(F.filter(stripped, lambda node: node != ""), " ")


def truncate(text: Column, n: int = CONTENT_CHARS) -> Column:
    """The first ``n`` characters, counted in code points."""
    return F.substring(text, 1, n)


def render_prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), text, F.lit(PROMPT_TAIL))


def to_request(prompt: Column, model: str = MODEL) -> Column:
    """The JSON body of a model call."""
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            prompt.alias("prompt"),
            F.lit("json").alias("format"),
            F.lit(False).alias("stream"),
        )
    )

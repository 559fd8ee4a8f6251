"""Resolution of relative references, as RFC 3986 defines it in section 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.once import let

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"


def has_scheme(url: Column) -> Column:
    return url.rlike(_SCHEME)


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment; NULL is undefined, which is not empty."""
    rest = F.regexp_replace(url, _SCHEME, "")

    def defined(pattern: str, text: Column) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))

    return F.struct(
        defined(_SCHEME, url).alias("scheme"),
        defined(r"\A//([^/?#]*)", rest).alias("authority"),
        F.regexp_extract(rest, r"\A(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        defined(r"\A[^?#]*\?([^#]*)", rest).alias("query"),
        defined(r"(?s)\A[^#]*#(.*)\z", rest).alias("fragment"),
    )


def remove_dot_segments(path: Column) -> Column:
    """A path without ``.`` and ``..``: one pass over its segments, each with its slash."""
    relative = F.regexp_replace(F.regexp_replace(path, r"\A(?:\.\.?/)+", ""), r"\A\.\.?\z", "")
    # A last dot segment leaves a slash behind.
    ended = F.regexp_replace(relative, r"(/\.\.?)\z", "$1/")
    segments = F.regexp_extract_all(ended, F.lit(r"/[^/]*|\A[^/]+"), F.lit(0))

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "/.", kept)
            .when(segment == "/..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    walked = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "")
    return F.when(path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), walked).otherwise(path)


def _resolved(ref: Column, base: Column) -> Column:
    own_authority = ref["scheme"].isNotNull() | ref["authority"].isNotNull()
    merged = F.when(base["authority"].isNotNull() & (base["path"] == ""), F.concat(F.lit("/"), ref["path"])).otherwise(
        F.concat(F.regexp_replace(base["path"], r"[^/]*\z", ""), ref["path"])
    )
    path = (
        F.when(own_authority | ref["path"].startswith("/"), remove_dot_segments(ref["path"]))
        .when(ref["path"] == "", base["path"])
        .otherwise(remove_dot_segments(merged))
    )
    query = F.when(~own_authority & (ref["path"] == ""), F.coalesce(ref["query"], base["query"])).otherwise(ref["query"])

    def put(before: str, part: Column, after: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(before), part, F.lit(after)), F.lit(""))

    return F.concat(
        put("", F.coalesce(ref["scheme"], base["scheme"]), ":"),
        put("//", F.when(own_authority, ref["authority"]).otherwise(base["authority"])),
        path,
        put("?", query),
        put("#", ref["fragment"]),
    )


def resolve(reference: Column, base: Column) -> Column:
    """``reference`` against ``base``, another URL; NULL in either gives the reference.

    A base without a scheme, which the RFC does not allow, leaves one out of the result. A
    reference with a scheme is taken as it is, dots included, as feed readers do.
    """
    both = F.struct(_parts(F.trim(reference)).alias("ref"), _parts(F.trim(base)).alias("base"))
    found = let(both, lambda b: _resolved(b["ref"], b["base"]))
    return F.when(reference.isNull() | base.isNull() | has_scheme(F.trim(reference)), reference).otherwise(found)

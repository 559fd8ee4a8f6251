"""URL filters by dated lists: every capture meets the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.asof import asof, intervals
from feedloom.operators.skew import join_by_key
from feedloom.session import materialize

# Kinds of entries, the most specific first.
KINDS = ("url", "prefix", "host", "domain")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path up to a query or fragment, from its first slash on; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column, labels: int, depth: int) -> Column:
    """What entries can name a URL by: ``kind:value``.

    The URL itself, its directories of up to ``depth`` names, its host, and the host's
    domains of two up to ``labels`` labels. A URL without a host only has itself.
    """
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    names = F.slice(F.split(path_of(url), "/"), 2, depth + 1)
    directories = F.transform(
        F.sequence(F.lit(0), F.least(F.size(names) - 1, F.lit(depth))),
        lambda n: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.transform(F.slice(names, 1, n), lambda x: F.concat(x, F.lit("/"))), "")),
    )
    suffixes = F.transform(
        F.sequence(F.lit(2), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")),
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.when(url.isNull(), none).otherwise(F.array(F.concat(F.lit("url:"), url))),
            F.when(host.isNull() | (path_of(url) == ""), none).otherwise(directories),
            F.when(host.isNull(), none).otherwise(F.array(F.concat(F.lit("host:"), host))),
            F.when(host.isNull() | (F.size(parts) < 2) | F.lit(labels < 2), none).otherwise(suffixes),
        )
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with the verdict of the lists at the time of their fetch.

    ``captures`` has ``url, fetched_at`` and any other columns. ``entries`` has ``list``,
    ``kind`` (one of `KINDS`), ``value``, ``allow``, ``listed_at`` and ``active``: from
    ``listed_at`` on the list does or does not have the value, until the next entry of the
    same list, kind and value. A prefix is a host and directories with a closing slash; a
    domain has two labels or more.

    Adds, in place of columns of the same names, ``active_entries`` (how many are active), ``rule`` and ``rule_list`` (the most
    specific of them: by kind, then the longer value; of equal ones a blocking one, then
    the first list by name) and ``blocked``: whether there is a rule and it does not allow.
    Captures without a URL or a time are not blocked; entries with a null are not used.

    A verdict depends on URL and time only, so repeated captures are looked up once. Of
    their keys only those that some list names are followed, and a hot one is dealt out.
    """
    entries = entries.dropna(subset=["list", "kind", "value", "allow", "listed_at", "active"]).withColumn(
        "key", F.concat_ws(":", "kind", "value")
    )
    # How deep the entries of all lists go.
    bounds = entries.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 2)).alias("depth"),
    ).first()
    asked = captures.where("url IS NOT NULL AND fetched_at IS NOT NULL").select(
        F.col("url").alias("_url"), F.col("fetched_at").alias("_at")
    ).distinct()
    keyed = asked.withColumn("key", F.explode(keys_of(F.col("_url"), bounds["labels"] or 0, max(0, bounds["depth"] or 0))))
    listed = materialize(
        entries.groupBy("key").agg(F.collect_set(F.struct("list", "allow")).alias("lists")), "urls-listed"
    )
    met = join_by_key(keyed, listed, ["key"], "inner", ["_url", "_at"]).select(
        "_url", "_at", "key", F.explode("lists").alias("one")
    ).select("_url", "_at", "key", "one.list", "one.allow")
    met = materialize(met, "urls-met")
    valid = materialize(intervals(entries, ["key", "list", "allow"], "listed_at", "active"), "urls-valid")
    active = asof(met, valid, ["key", "list", "allow"], "_at")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.split_part("key", F.lit(":"), F.lit(1)))
    verdicts = materialize(
        active.groupBy("_url", "_at").agg(
            F.count(F.lit(1)).alias("active_entries"),
            F.min(F.struct(kind.alias("kind"), (-F.char_length("key")).alias("short"), "allow", "list", "key")).alias("rule"),
        ),
        "urls-verdicts",
    )
    rows = captures.select(
        F.struct("*").alias("row"), F.col("url").alias("_url"), F.col("fetched_at").alias("_at")
    )
    added = ("active_entries", "rule", "rule_list", "blocked")
    return join_by_key(rows, verdicts, ["_url", "_at"], "left", ["_url", "_at"]).select(
        *(F.col("row").getField(name).alias(name) for name in captures.columns if name not in added),
        F.coalesce("active_entries", F.lit(0).cast("long")).alias("active_entries"),
        F.col("rule.key").alias("rule"),
        F.col("rule.list").alias("rule_list"),
        F.coalesce(~F.col("rule.allow"), F.lit(False)).alias("blocked"),
    )

"""Explicit schemas; no reader in this package infers one."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


CATALOG_JSON = MapType(StringType(), ArrayType(StringType()))

CATALOG = StructType(
    [
        StructField("category", StringType()),
        StructField("category_pos", IntegerType()),
        StructField("feed_url", StringType()),
        StructField("feed_pos", IntegerType()),
    ]
)

# One schema for RSS 2.0 (channel.item), RSS 1.0 (channel and item side by side)
# and Atom (entry); the parts a document lacks come out as NULL.
_ITEM = (
    "struct<title:string, link:string, description:string, `content:encoded`:string,"
    " guid:struct<_VALUE:string, _isPermaLink:string>, pubDate:string, `_xml:base`:string>"
)
_ENTRY = (
    "struct<title:string, link:array<struct<_href:string, _rel:string, _type:string, `_xml:base`:string>>,"
    " `_xml:base`:string, summary:string, content:string, published:string, issued:string>"
)
FEED_XML = (
    f"struct<title:string, `_xml:base`:string, channel:struct<title:string, `_xml:base`:string, item:array<{_ITEM}>>,"
    f" item:array<{_ITEM}>, entry:array<{_ENTRY}>, _corrupt_record:string>"
)

ARTICLE = StructType(
    _strings(
        "category",
        "source_name",
        "source_url",
        "title_en",
        "title_pt",
        "summary_en",
        "summary_pt",
    )
)

# `published_at` is the time of insertion. The date an entry carries in its feed
# decides only whether it is recent; it is kept beside it as `entry_published_at`.
NEWS = StructType(
    [
        *_strings("id"),
        *ARTICLE.fields,
        StructField("entry_published_at", TimestampType()),
        StructField("published_at", TimestampType()),
        StructField("published_date", DateType()),
    ]
)

EDITABLE = ("title_en", "title_pt", "summary_en", "summary_pt", "category")


# The four-string answer of the model, read as a map because a struct cannot tell
# an absent key from an explicit null.
ANSWER = MapType(StringType(), StringType())

"""First-wins batches, insert-if-new, outcomes, edits, payload files."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.edit import apply_deletes, apply_updates, delete_news, update_news
from feedloom.operators.harvest import first_by_key
from feedloom.operators.publish import (
    already_known,
    classify_error,
    new_only,
    outcomes,
    publish,
    publish_report,
)
from feedloom.schema import ARTICLE
from feedloom.session import materialize, scratch_path
from feedloom.sources.news import append_news, read_news
from feedloom.sources.arrays import read_array_payload
from feedloom.sources.payload import read_payload, write_payload
from feedloom.plans.publish import publish_payload
from feedloom.streaming.metrics import read_rollup, rebuild_rollup, rollup_totals, write_rollup
from feedloom.streaming.publish import stream_publish
from queries import query
from queries.inputs import SQL_NEWS, SQL_STAMP, news_view, stamp

_NOW = "2024-02-01 12:00:00"
_ORDER = ["doc_id"]


def _halves(spark, sf_dir):
    """A batch (odd numbers, some without a URL) and the rows published before."""
    news = news_view(spark, sf_dir)
    url = F.when(F.col("doc_id") % 13 != 0, F.col("source_url"))
    batch = news.where(F.col("doc_id") % 2 == 1).withColumn("source_url", url)
    return batch.drop("id", "published_at"), news.where(F.col("doc_id") % 2 == 0)


_SQL_HALVES = f"""
    news_v AS ({SQL_NEWS}),
    old AS (SELECT * FROM news_v WHERE doc_id % 2 = 0),
    batch AS (SELECT * REPLACE (CASE WHEN doc_id % 13 <> 0 THEN source_url END AS source_url)
              FROM news_v WHERE doc_id % 2 = 1),
    marked AS (
        SELECT *, CASE WHEN source_url IS NULL THEN 'error'
                       WHEN source_url IN (SELECT source_url FROM old)
                         OR row_number() OVER (PARTITION BY source_url ORDER BY doc_id) > 1
                       THEN 'duplicate' ELSE 'inserted' END AS outcome
        FROM batch
    )
"""


@query(
    f"""
    SELECT doc_id, source_url, source_name FROM ({SQL_NEWS})
    QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY doc_id) = 1
    """
)
def batch_first_wins(spark, sf_dir):
    first = first_by_key(news_view(spark, sf_dir), "source_url", _ORDER)
    return first.select("doc_id", "source_url", "source_name")


@query(
    f"""
    WITH {_SQL_HALVES}
    SELECT doc_id, sha256(source_url) AS id, source_url, category, title_en, summary_pt,
           '2024-02-01 12:00:00.000000' AS published_at, '2024-02-01' AS published_date
    FROM marked WHERE outcome = 'inserted'
    """
)
def publish_new(spark, sf_dir):
    batch, old = _halves(spark, sf_dir)
    return publish(batch, old, _NOW, _ORDER).select(
        "doc_id",
        "id",
        "source_url",
        "category",
        "title_en",
        "summary_pt",
        stamp("published_at").alias("published_at"),
        F.col("published_date").cast("string").alias("published_date"),
    )


@query(
    f"""
    WITH {_SQL_HALVES}, firsts AS (
        SELECT * FROM batch WHERE source_url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY doc_id) = 1
    )
    SELECT doc_id, source_url FROM firsts
    WHERE source_url NOT IN (SELECT source_url FROM old)
    """
)
def new_keys_only(spark, sf_dir):
    batch, old = _halves(spark, sf_dir)
    unique = first_by_key(batch.where(F.col("source_url").isNotNull()), "source_url", _ORDER)
    return new_only(unique, old).select("doc_id", "source_url")


@query(
    f"""
    WITH {_SQL_HALVES}
    SELECT doc_id, source_url, title_en FROM batch
    WHERE source_url IN (SELECT source_url FROM old)
    """
)
def publish_known(spark, sf_dir):
    batch, old = _halves(spark, sf_dir)
    return already_known(batch, old, _ORDER).select("doc_id", "source_url", "title_en")


@query(f"WITH {_SQL_HALVES} SELECT doc_id, source_url, outcome FROM marked")
def publish_outcomes(spark, sf_dir):
    batch, old = _halves(spark, sf_dir)
    marked = outcomes(batch, publish(batch, old, _NOW, _ORDER), _ORDER)
    return marked.select("doc_id", "source_url", "outcome")


@query(
    f"""
    WITH {_SQL_HALVES}
    SELECT count_if(outcome = 'inserted')::BIGINT AS inserted,
           count_if(outcome = 'duplicate')::BIGINT AS skipped,
           count_if(outcome = 'error')::BIGINT AS failed, count(*) AS total
    FROM marked
    """
)
def publish_tally(spark, sf_dir):
    batch, old = _halves(spark, sf_dir)
    return publish_report(outcomes(batch, publish(batch, old, _NOW, _ORDER), _ORDER))


@query(
    """
    SELECT doc_id, CASE WHEN doc_id % 3 IN (0, 1) THEN 'duplicate' ELSE 'error' END AS outcome
    FROM documents
    """
)
def error_classes(spark, sf_dir):
    form = F.col("doc_id") % 3
    message = F.concat(
        F.when(form == 0, F.lit("ERROR: Duplicate key value "))
        .when(form == 1, F.lit("violates UNIQUE constraint "))
        .otherwise(F.lit("connection reset ")),
        F.col("source_url"),
    )
    return news_view(spark, sf_dir).select("doc_id", classify_error(message).alias("outcome"))


def _patches(news):
    """Some ids get two patches, some columns get NULL, some ids are unknown."""
    form = F.col("doc_id") % 5

    def fields(**values):
        columns = [x for k, v in values.items() for x in (F.lit(k), v)]
        return F.create_map(*columns).cast("map<string,string>")

    first = news.where(form < 2).select(
        "id",
        F.when(form == 0, fields(title_en=F.concat(F.lit("new "), "id")))
        .otherwise(fields(category=F.lit(None), summary_pt=F.lit("")))
        .alias("patch"),
        F.lit(1).alias("seq"),
    )
    second = news.where(F.col("doc_id") % 10 == 0).select(
        "id",
        fields(title_en=F.lit("newer"), title_pt=F.lit("mais novo"), id=F.lit("x")).alias("patch"),
        F.lit(2).alias("seq"),
    )
    unknown = news.where(F.col("doc_id") % 7 == 0).select(
        F.concat(F.lit("no-"), "id").alias("id"),
        fields(title_en=F.lit("nobody")).alias("patch"),
        F.lit(1).alias("seq"),
    )
    return first.unionByName(second).unionByName(unknown)


_SQL_UPDATED = f"""
    SELECT id, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE category END AS category, source_url,
           CASE WHEN doc_id % 10 = 0 THEN 'newer' WHEN doc_id % 5 = 0 THEN 'new ' || id
                ELSE title_en END AS title_en,
           CASE WHEN doc_id % 10 = 0 THEN 'mais novo' ELSE title_pt END AS title_pt, summary_en,
           CASE WHEN doc_id % 5 = 1 THEN '' ELSE summary_pt END AS summary_pt,
           doc_id
    FROM ({SQL_NEWS})
"""
_EDITED = ["id", "category", "source_url", "title_en", "title_pt", "summary_en", "summary_pt"]


@query(f"SELECT * EXCLUDE (doc_id) FROM ({_SQL_UPDATED})", name="update_news")
def edited_news(spark, sf_dir):
    news = news_view(spark, sf_dir)
    return update_news(news, _patches(news)).select(*_EDITED)


def _deleted_ids(news):
    ids = news.where(F.col("doc_id") % 4 == 0).select("id")
    return ids.unionByName(ids).unionByName(ids.select(F.concat(F.lit("no-"), "id").alias("id")))


@query(f"SELECT id, source_url FROM ({SQL_NEWS}) WHERE doc_id % 4 <> 0", name="delete_news")
def remaining_news(spark, sf_dir):
    news = news_view(spark, sf_dir)
    return delete_news(news, _deleted_ids(news)).select("id", "source_url")


@query(f"SELECT * EXCLUDE (doc_id) FROM ({_SQL_UPDATED}) WHERE doc_id % 4 <> 0")
def edited_table(spark, sf_dir):
    """The same edits made to a stored table, day by day."""
    news = materialize(news_view(spark, sf_dir), "news-view")
    path = scratch_path(spark, "news")
    undated = F.lit(None).cast("timestamp")
    append_news(news.withColumn("entry_published_at", undated), path)
    apply_updates(spark, path, _patches(news))
    apply_deletes(spark, path, _deleted_ids(news))
    return read_news(spark, path).select(*_EDITED)


@query(
    f"""
    SELECT category, source_name, source_url, title_en,
           CASE WHEN doc_id % 3 = 0 THEN NULL ELSE title_pt END AS title_pt, summary_en, summary_pt
    FROM ({SQL_NEWS})
    """
)
def payload_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "payload")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("title_pt"))
    write_payload(news_view(spark, sf_dir).withColumn("title_pt", title), path, ("doc_id",))
    return read_payload(spark, path).select(*ARTICLE.names)


_SQL_UNKEYED = f"""
    SELECT * REPLACE (CASE WHEN doc_id % 19 <> 0 THEN source_url END AS source_url) FROM ({SQL_NEWS})
"""


def _unkeyed(spark, sf_dir):
    url = F.when(F.col("doc_id") % 19 != 0, F.col("source_url"))
    return news_view(spark, sf_dir).withColumn("source_url", url)


@query(
    f"""
    SELECT count(DISTINCT source_url) AS inserted, count(source_url) - count(DISTINCT source_url) AS skipped,
           count(*) - count(source_url) AS failed, count(*) AS total
    FROM ({_SQL_UNKEYED})
    """
)
def publish_run(spark, sf_dir):
    """A payload written and published; publishing it again adds nothing."""
    payload, news = scratch_path(spark, "payload"), scratch_path(spark, "news")
    write_payload(_unkeyed(spark, sf_dir), payload, ("doc_id",))
    return publish_payload(spark, payload, news, "2024-02-01 12:00:00")


@query(
    f"""
    SELECT CASE WHEN doc_id % 23 = 0 THEN 'unreadable' ELSE 'no source_url' END AS reason,
           CAST(count(*) AS BIGINT) AS n
    FROM ({_SQL_UNKEYED}) WHERE doc_id % 23 = 0 OR source_url IS NULL GROUP BY 1
    """
)
def payload_rejects(spark, sf_dir):
    """Lines that are cut and articles without a URL, as a stream sets them aside."""
    landing, news = scratch_path(spark, "landing"), scratch_path(spark, "news")
    line = F.to_json(F.struct(*ARTICLE.names))
    cut = F.when(F.col("doc_id") % 23 == 0, F.substring(line, 1, 20)).otherwise(line)
    _unkeyed(spark, sf_dir).select(cut.alias("value")).write.text(landing)
    stream_publish(
        spark, landing, news, scratch_path(spark, "checkpoint"), clock=lambda: "2024-02-01 12:00:00"
    ).awaitTermination()
    rejects = spark.read.schema("text string, payload_file string, reason string").json(f"{news}-rejects")
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT category, source_name, source_url, title_en, title_pt, summary_en, summary_pt FROM ({SQL_NEWS})")
def payload_arrays(spark, sf_dir):
    """Payloads of one JSON array per file, a hundred articles each."""
    path = scratch_path(spark, "arrays")
    parts = F.floor(F.col("doc_id") / 100).alias("part")
    arrays = news_view(spark, sf_dir).groupBy(parts).agg(
        F.to_json(F.collect_list(F.struct(*ARTICLE.names))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    return read_payload(spark, f"{path}/part=*", array=True).select(*ARTICLE.names)


@query(
    f"""
    SELECT category, source_name, source_url, title_en, title_pt, summary_en, summary_pt, true AS shared
    FROM ({SQL_NEWS})
    """
)
def payload_array_splits(spark, sf_dir):
    """Arrays of a thousand articles; every file is read in splits of 64 KiB, so by many tasks."""
    path = scratch_path(spark, "large-arrays")
    parts = F.floor(F.col("doc_id") / 1000).alias("part")
    arrays = news_view(spark, sf_dir).groupBy(parts).agg(
        F.to_json(F.collect_list(F.struct(*ARTICLE.names))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    articles = read_array_payload(spark, f"{path}/part=*", split_bytes=1 << 16)
    splits = articles.groupBy("payload_file").agg((F.count_distinct("payload_block") > 1).alias("shared"))
    return articles.join(F.broadcast(splits), "payload_file").select(*ARTICLE.names, "shared")


@query(
    f"""
    SELECT count(*) AS total, count(DISTINCT source_name) AS active_sources
    FROM ({SQL_NEWS}) WHERE doc_id % 4 <> 0
    """
)
def rollup_rebuilt(spark, sf_dir):
    """Counts of two batches, counted anew after deletes."""
    news, path = news_view(spark, sf_dir), scratch_path(spark, "rollup")
    for parity in (0, 1):
        write_rollup(news.where(F.col("doc_id") % 2 == parity), path, parity)
    rebuild_rollup(news.where(F.col("doc_id") % 4 != 0), path)
    return rollup_totals(read_rollup(spark, path))

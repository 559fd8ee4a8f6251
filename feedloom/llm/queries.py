"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.ann import nearest
from feedloom.llm.common import table
from feedloom.llm.conversations import damaged, repair_report
from feedloom.llm.exact import exact_duplicates
from feedloom.llm.lexical import ranked_search
from feedloom.llm.minhash import near_duplicates
from feedloom.llm.packing import pack
from feedloom.llm.passages import drop_repeated_passages
from feedloom.llm.pieces import decode_pieces, encode_pieces
from feedloom.llm.quality import quality
from feedloom.llm.resharding import lay_out, near_equal, reshard, vacuum
from feedloom.llm.urlfilter import filter_urls, host_of, path_of
from feedloom.llm.warc import read_warc, write_warc
from feedloom.llm.wavelet import read_tokens, write_tokens

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0, capacity=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the digest is of the text that comes back."""
    encoded = encode_pieces(table(spark, sf_dir, "documents"), PIECES, n=4)
    digests = encoded.withColumn("ids_crc32", F.crc32("ids")).withColumn("score", F.get("scores", F.lit(0)))
    return decode_pieces(digests, PIECES).withColumn("text_sha1", F.sha1("text")).drop("text")


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return read_tokens(manifest, ids=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), least_bytes=1000)
    return read_warc(files, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5)
    return found.drop("text_key", "class_key")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture, and a third list user reports something of its URL.

    A page's number gives both moments, in 30 days. What is reported is the page's domain,
    host, directory or URL by turns, to one of three lists of which the last allows; every
    fifth report takes a value off its list again.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")

    def moment(factor: int):
        return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * factor, F.lit(2_592_000)))

    kind, host = F.col("page_id") % 4, host_of(F.col("url"))
    directory = F.concat(host, F.lit("/"), F.split_part(path_of(F.col("url")), F.lit("/"), F.lit(2)), F.lit("/"))
    value = (
        F.when(kind == 0, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
        .when(kind == 1, host)
        .when(kind == 2, directory)
        .otherwise(F.col("url"))
    )
    names = F.when(kind == 0, "domain").when(kind == 1, "host").when(kind == 2, "prefix").otherwise("url")
    entries = pages.select(
        F.concat(F.lit("list"), (F.col("page_id") % 3).cast("string")).alias("list"),
        names.alias("kind"),
        value.alias("value"),
        (F.col("page_id") % 3 == 2).alias("allow"),
        moment(104_729).alias("listed_at"),
        (F.col("page_id") % 5 != 4).alias("active"),
    )
    filtered = filter_urls(pages.withColumn("fetched_at", moment(7_919)), entries)
    return filtered.withColumn("fetched_at", F.unix_seconds("fetched_at")).drop("url")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("key", "chars")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_passages(docs, least=3, words=15, enough=50, anywhere=50)


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty shards by source, of which one or two are far too large, become 24 even ones."""
    old = lay_out(table(spark, sf_dir, "documents"), 20, F.pmod(F.xxhash64("source"), F.lit(20)))
    new = reshard(old, near_equal(sum(old.sizes()), 24))
    vacuum(old, new)
    return new.read(columns=("row.doc_id", "row.text")).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_wavelet": op3_wavelet,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_url_filter": op7_url_filter,
    "op8_ann": op8_ann,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_passages": op10_passages,
    "op11_resharding": op11_resharding,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}

# Queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM m
    """,
    "op7_url_filter": r"""
        WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
                          regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path,
                          1704067200 + page_id * 7919 % 2592000 AS fetched_at,
                          1704067200 + page_id * 104729 % 2592000 AS listed_at FROM pages),
        e AS (SELECT 'list' || (page_id % 3) AS list, page_id % 3 = 2 AS allow, listed_at,
                     page_id % 5 <> 4 AS active,
                     CASE page_id % 4 WHEN 0 THEN 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1)
                          WHEN 1 THEN 'host:' || host
                          WHEN 2 THEN 'prefix:' || host || '/' || split_part(path, '/', 2) || '/'
                          ELSE 'url:' || url END AS key FROM p),
        u AS (SELECT list, allow, key, listed_at, max(active) AS active FROM e GROUP BY ALL),
        m AS (SELECT page_id, list, allow, key, arg_max(u.active, u.listed_at) AS active
              FROM p JOIN u ON u.listed_at <= fetched_at AND (
                   key = 'url:' || url OR key = 'host:' || host
                   OR (starts_with(key, 'domain:') AND (ends_with('.' || host, '.' || key[8:])))
                   OR (starts_with(key, 'prefix:') AND starts_with(host || path, key[8:])))
              GROUP BY ALL),
        a AS (SELECT *, CASE split_part(key, ':', 1) WHEN 'url' THEN 1 WHEN 'prefix' THEN 2
                             WHEN 'host' THEN 3 ELSE 4 END AS kind FROM m WHERE active),
        r AS (SELECT page_id, count(*) AS n, arg_min(struct_pack(key := key, list := list, allow := allow),
                     struct_pack(kind := kind, short := -length(key), allow := allow, list := list)) AS rule FROM a GROUP BY page_id)
        SELECT p.page_id, fetched_at, coalesce(n, 0) AS active_entries, rule.key AS rule,
               rule.list AS rule_list, coalesce(NOT rule.allow, false) AS blocked
        FROM p LEFT JOIN r USING (page_id)
    """,
    "op9_exact_dedup": r"""
        SELECT doc_id, first(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
                     regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
              FROM documents)
        WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
    """,
    "op12_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
              WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
              FROM p, c GROUP BY term, n_docs),
        m AS (SELECT doc_id, 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM d, c WHERE len(terms) > 0),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
              FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
            FROM (SELECT unnest(range(256))::BIGINT AS i)),
        hit AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT,
                           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                          lambda c: ascii(c)::BIGINT)),
                       lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS fate
            FROM conversations, crc),
        damaged AS (
            SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM hit WHERE fate <> 0),
        placed AS (
            SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS initial,
                   lag(substr(role, 1, 1)) OVER w AS previous,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
                   regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid
            FROM damaged
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
        faults AS (
            SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN later THEN 'duplicate'
                           WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id),
        -- From the end: the cheapest way on from each state (0 start, 1 s, 2 u, 3 a), as cost and letters.
        ways AS (
            SELECT conv_id, n AS pos, {'c': 0, 'l': ''} AS w0, {'c': 4, 'l': 'II'} AS w1, {'c': 2, 'l': 'I'} AS w2, {'c': 0, 'l': ''} AS w3
            FROM counted
            UNION ALL
            SELECT conv_id, pos, least(d0, {'c': least(d2, i2).c + 2, 'l': 'I' || least(d2, i2).l}),
                   least(d1, {'c': least(d2, i2).c + 2, 'l': 'I' || least(d2, i2).l}),
                   least(d2, i2), least(d3, {'c': d2.c + 2, 'l': 'I' || d2.l})
            FROM (
                SELECT *, {'c': d3.c + 2, 'l': 'I' || d3.l} AS i2 FROM (
                    SELECT w.conv_id, w.pos - 1 AS pos,
                           least(x0, CASE WHEN NOT gone THEN {'c': w2.c + cut + 2, 'l': 'R' || w2.l} ELSE x0 END,
                                 CASE WHEN NOT gone AND initial = 'u' THEN {'c': w2.c + cut, 'l': 'K' || w2.l}
                                      WHEN NOT gone AND initial = 's' THEN {'c': w1.c + cut, 'l': 'K' || w1.l} ELSE x0 END) AS d0,
                           least(x1, CASE WHEN NOT gone THEN {'c': w2.c + cut + 2, 'l': 'R' || w2.l} ELSE x1 END,
                                 CASE WHEN NOT gone AND initial = 'u' THEN {'c': w2.c + cut, 'l': 'K' || w2.l} ELSE x1 END) AS d1,
                           least(x2, CASE WHEN NOT gone THEN {'c': w3.c + cut + 2, 'l': 'R' || w3.l} ELSE x2 END,
                                 CASE WHEN NOT gone AND initial = 'a' THEN {'c': w3.c + cut, 'l': 'K' || w3.l} ELSE x2 END) AS d2,
                           least(x3, CASE WHEN NOT gone THEN {'c': w2.c + cut + 2, 'l': 'R' || w2.l} ELSE x3 END,
                                 CASE WHEN NOT gone AND initial = 'u' THEN {'c': w2.c + cut, 'l': 'K' || w2.l} ELSE x3 END) AS d3
                    FROM (SELECT *, {'c': w0.c + 3, 'l': 'D' || w0.l} AS x0, {'c': w1.c + 3, 'l': 'D' || w1.l} AS x1,
                                 {'c': w2.c + 3, 'l': 'D' || w2.l} AS x2, {'c': w3.c + 3, 'l': 'D' || w3.l} AS x3
                          FROM ways WHERE pos > 0) w
                    JOIN (SELECT conv_id AS id, pos AS place, initial, fault IN ('blank', 'duplicate') AS gone,
                                 (fault = 'truncated')::INT AS cut FROM faults) f
                      ON id IS NOT DISTINCT FROM w.conv_id AND place = w.pos))),
        best AS (SELECT conv_id, w0.c AS cost, w0.l AS audit FROM ways WHERE pos = 0),
        edits AS (
            SELECT conv_id, i, substr(audit, i, 1) AS letter,
                   i - length(replace(substr(audit, 1, i), 'I', '')) AS ins,
                   i - length(replace(substr(audit, 1, i - 1), 'D', '')) AS gone
            FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)),
        made AS (
            SELECT e.conv_id, i, e.letter, role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS k,
                   first(letter = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id ORDER BY i) AS led
            FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND letter <> 'I' AND pos = i - ins
            WHERE letter <> 'D'),
        lines AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - coalesce(led, false)::INT) % 2 = 1 THEN 'user'
                                            ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole
            FROM made GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}

"""Exact duplicates through an extendible-hash index on shared files.

DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import keep_rows
from feedloom.operators.skew import broadcast_if_small, join_by_key
from feedloom.session import materialize, scratch_path

# The characters that do not count, 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """A text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _key(norm: Column, hash_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - hash_bits)


def directory(keys: DataFrame, hash_bits: int, bucket_keys: int) -> DataFrame:
    """The directory of an extendible-hash index over distinct ``key`` values.

    Starting from one bucket, every bucket with more than ``bucket_keys`` keys is split
    by the next leading bit of the key, and the directory doubles when a split needs a
    bit more than it has. Keys are hashes, so each doubling halves what a slot holds and
    the directory ends near ``keys / bucket_keys`` slots. Returns one row per slot:
    ``slot`` (the leading ``depth`` bits), ``bucket`` (its first slot), ``local_depth``
    and ``depth``.
    """
    depth = 0
    while True:
        slot = F.shiftrightunsigned("key", hash_bits - depth) if depth else F.lit(0).cast("long")
        slots = keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        # Counts of the slots of this depth, not of documents.
        if depth >= hash_bits or slots.where(F.col("n") > bucket_keys).isEmpty():
            break
        depth += 1
    local = F.lit(depth)
    for shorter in reversed(range(depth)):
        prefix = F.shiftrightunsigned("slot", depth - shorter)
        held = F.sum("n").over(Window.partitionBy(prefix))
        local = F.when(held <= bucket_keys, shorter).otherwise(local)
    cut = f"{depth} - local_depth"
    return (
        slots.withColumn("local_depth", local)
        .withColumn("depth", F.lit(depth))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {cut}), {cut})"))
        .select("slot", "bucket", "local_depth", "depth")
    )


def build_index(
    entries: DataFrame, folder: str, hash_bits: int, bucket_keys: int
) -> tuple[DataFrame, DataFrame]:
    """Write the directory and the buckets of an index under ``folder``.

    ``entries`` has one row per distinct ``key, sha, chars``. A bucket's entries are
    written by the task that owns its key range, in the order of keys, so entries of one
    key are chained next to each other. Returns (directory, buckets) as read back.
    """
    spark = entries.sparkSession
    slots = directory(entries.select("key").distinct(), hash_bits, bucket_keys)
    slots.write.parquet(f"{folder}/directory")
    slots = spark.read.parquet(f"{folder}/directory")
    depth = slots.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    slot = F.shiftrightunsigned("key", hash_bits - depth) if depth else F.lit(0).cast("long")
    placed = entries.withColumn("slot", slot).join(
        broadcast_if_small(slots.select("slot", "bucket")), "slot"
    )
    (
        placed.drop("slot")
        .repartitionByRange("bucket", "key")
        .sortWithinPartitions("bucket", "key", "sha")
        .write.partitionBy("bucket")
        .parquet(f"{folder}/buckets")
    )
    schema = placed.drop("slot").schema
    return slots, spark.read.schema(schema).parquet(f"{folder}/buckets")


def exact_duplicates(
    docs: DataFrame, hash_bits: int = 63, bucket_keys: int = 1 << 15, folder: str | None = None
) -> DataFrame:
    """Which documents have equal texts, and which of them stays.

    ``docs`` has ``doc_id, text``; other columns are not read. Texts are equal when their
    bytes are, once blanks are deleted; a null text is empty. Of equal texts the one with
    the most code points stays, then the one with the smallest ``doc_id`` (a missing one
    comes last). Of repeated rows of one document that all would stay, one does. Returns
    one row per document: ``doc_id, keep_id, group_size, kept, text_sha256, key, chars``.

    1. One scan writes a light entry per document: a hash key, a digest, a length.
    2. Entries that agree in all of these are counted together before any shuffle, so a
       group of copies is one row from then on. They fill an extendible-hash index.
    3. Keys with more than one document in their chain have their texts read again and
       compared byte by byte, again combined before the shuffle.
    4. Each document looks up its group; documents of no group are alone.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "exact-index")
    norm = normalised(F.col("text"))
    light = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            norm.alias("norm"),
            F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        ).select(
            "doc_id",
            _key(F.col("norm"), hash_bits).alias("key"),
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            "chars",
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-entries",
    )
    # The smallest doc_id, missing ones last, and then the smallest row.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")
    entries = light.groupBy("key", "sha", "chars").agg(F.count(F.lit(1)).alias("n"), first)
    _, buckets = build_index(entries, folder, hash_bits, bucket_keys)

    chains = buckets.groupBy("key").agg(F.sum("n").alias("n"), F.count_distinct("sha").alias("digests"))
    shared = materialize(chains.where("n > 1").select("key"), "exact-shared")
    texts = docs.select(norm.alias("norm")).withColumn("key", _key(F.col("norm"), hash_bits))
    compared = (
        join_by_key(texts, shared, ["key"], "left_semi", ["norm"])
        .groupBy("key", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    )
    # A digest that stood for two texts would make two rows here.
    groups = compared.groupBy("key", "sha").agg(
        F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    one_text = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts have one SHA-256"))
    )
    best = buckets.groupBy("key", "sha").agg(
        F.min(F.struct((-F.col("chars")).alias("longest"), "first")).alias("best")
    )
    groups = (
        groups.select("key", "sha", one_text.cast("long").alias("group_size"))
        .where("group_size > 1")
        .join(best, ["key", "sha"])
        .select(
            "key",
            "sha",
            "group_size",
            F.col("best.first.doc_id").alias("keep_id"),
            F.col("best.first.row").alias("keep_row"),
        )
    )
    groups = materialize(groups, "exact-groups")
    alone = F.col("group_size").isNull()
    return join_by_key(light, groups, ["key", "sha"], "left", ["row"]).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "key",
        "chars",
    )


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Rows that repeat a document's number and text stay once as well.
    """
    marked = exact_duplicates(docs, **options)
    bits = options.get("hash_bits", 63)
    names = ["_id", "_key", "_sha", "_chars"]
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        normalised(F.col("text")).alias("_norm"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("_chars"),
    ).select("row", "_id", _key(F.col("_norm"), bits).alias("_key"), F.sha2("_norm", 256).alias("_sha"), "_chars")
    fates = materialize(
        marked.groupBy(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
            F.col("key").alias("_key"),
            F.col("text_sha256").alias("_sha"),
            F.col("chars").alias("_chars"),
        )
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("NOT kept OR n > 1"),
        "exact-fates",
    )
    return keep_rows(rows, fates, names)

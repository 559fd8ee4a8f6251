"""Similarity join on word n-grams: banded MinHash proposes, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import keep_rows, kept, record, small, texts
from feedloom.llm.components import components
from feedloom.operators.skew import join_by_key
from feedloom.session import materialize

_SIGNED = "doc_id long, text_key binary, set_id binary, n long, bands array<long>"
_SETS = "set_id binary, grams binary"
_FOUND = "set_id binary, links long, parent binary"
_FOUND_TYPES = {"set_id": pa.binary(), "links": pa.int64(), "parent": pa.binary()}


def choose_bands(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): pairs at the threshold meet in a band with probability ``recall``.

    The most rows a band can have within ``most_hashes``, for the fewest false meetings.
    """
    for rows in range(most_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("most_hashes is too small for this recall")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = found
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams.

    Words are what white space parts. A text of fewer words is one n-gram of all of them,
    a text without words has none.
    """
    words = text.split()
    known = kept(("hashes",), _WordHashes)
    if len(known) > 300_000:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    if not width:
        return hashes
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
    return np.unique(_mixed(total))


def signature(grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """A hash per band; equal sets have equal hashes. The set must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 63, size=(bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(1 << 63, size=(bands * rows, 1), dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[first : first + 4096] * factors + terms).min(1))
    mixed = _mixed(least).reshape(bands, rows)
    weights = rng.integers(1 << 63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _mixed((mixed * weights).sum(1, dtype=np.uint64)).view(np.int64)


def _similar(sets: list[np.ndarray], mask: np.ndarray, threshold: float) -> np.ndarray:
    """Of the masked pairs (row, column) those with a Jaccard similarity of ``threshold``."""
    n = np.array([len(s) for s in sets], np.int64)
    pairs = np.argwhere(mask)
    if len(pairs) <= 4 * len(sets):
        shared = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs]
        common = np.array(shared, np.int64)
    else:
        # Grams of one set only are in no intersection; the others become columns.
        whole = np.concatenate(sets)
        _, column, times = np.unique(whole, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        often = times[column] > 1
        renumbered = np.cumsum(times > 1) - 1
        owner, column = owner[often], renumbered[column[often]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        crossed = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            low, high = np.searchsorted(column, [first, first + 4096])
            incidence = np.zeros((len(sets), 4096), np.float32)
            incidence[owner[low:high], column[low:high] - first] = 1
            crossed += incidence @ incidence.T
        common = crossed[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    union = n[pairs[:, 0]] + n[pairs[:, 1]] - common
    return pairs[common / np.maximum(union, 1) >= threshold]


def _forest(names: list[bytes], pairs: np.ndarray) -> list[bytes | None]:
    """For each node the least name of its component among ``pairs``; None if it is that."""
    root = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[root] = np.arange(len(names))
    label, a, b = rank.copy(), pairs[:, 0], pairs[:, 1]
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        lower = lower[np.asarray(root)][lower]  # the label of the label's node
        if (lower == label).all():
            break
        label = lower
    return [None if label[i] == rank[i] else names[root[label[i]]] for i in range(len(names))]


def similar_sets(docs: DataFrame, threshold: float, recall: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(signed, found): a row per document, and links of distinct n-gram sets.

    ``signed`` has ``doc_id, text_key, set_id, n, bands``. ``found`` has rows of
    ``set_id, links, parent``: so many other sets are similar to it, and it hangs together
    with ``parent``; several rows of a set add up.
    """
    bands, rows = choose_bands(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [gram_set(text, size) for text in texts(batch)]
            columns = {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "n": [len(s) for s in sets],
                "bands": [signature(s, bands, rows) if len(s) else [] for s in sets],
            }
            kinds = {"set_id": pa.binary(), "n": pa.int64(), "bands": pa.list_(pa.int64())}
            yield record(columns, kinds)

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_key", F.unhex(F.md5("text")))
    signed = materialize(keyed.mapInArrow(sign, _SIGNED), "minhash-signed")

    # Texts with equal sets are one from here on, whatever their number.
    least = F.min(F.struct("doc_id", "text_key", "n", "bands")).alias("one")
    sets = materialize(signed.where("n > 0").groupBy("set_id").agg(least).select("set_id", "one.*"), "minhash-sets")
    members = sets.select("set_id", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        members.groupBy("band", "hash")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.sum("n").alias("grams"),
            F.bit_xor(F.xxhash64("set_id")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
        )
        .where("size > 1")
    )
    # Buckets with the same members in several bands are looked at once.
    buckets = materialize(
        buckets.groupBy("size", "x", "y")
        .agg(F.min(F.struct("band", "hash", "grams")).alias("b"))
        .select("b.band", "b.hash", F.greatest(F.ceil(F.col("size") / 1024), F.ceil(F.col("b.grams") / (1 << 20))).cast("int").alias("blocks")),
        "minhash-buckets",
    )
    met = materialize(
        join_by_key(members, buckets, ["band", "hash"], "inner", ["set_id"]), "minhash-met"
    )

    # The sets of those that met, from their texts, with the buckets each is in.
    own = met.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "hash"))).alias("in"))
    at_band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.try_element_at("in", b))
    own = own.select("set_id", at_band.alias("own"))
    wanted = sets.select("set_id", "doc_id", "text_key").join(own, "set_id")
    wanted = materialize(wanted, "minhash-wanted")
    chosen = (
        join_by_key(
            keyed.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
            wanted.select("set_id", "text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")),
            ["text_key", "_id"],
            "inner",
            ["text_key"],
        )
        .groupBy("set_id")
        .agg(F.min("text").alias("text"))
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                grams = [gram_set(text, size).tobytes() for text in texts(some)]
                yield record({"set_id": some.column("set_id"), "grams": grams}, {"grams": pa.binary()})

    grams = materialize(chosen.mapInArrow(load, _SETS), "minhash-grams")
    block = F.pmod(F.xxhash64("set_id"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = met.select("band", "hash", "set_id", block.alias("block"), other).select(
        "band",
        "hash",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "set_id",
    )
    contents = grams.join(wanted.select("set_id", "own"), "set_id")
    key = ["band", "hash", "low", "high"]
    tasks = (
        placed.join(contents, "set_id")
        .repartition(*key)
        .sortWithinPartitions(*key)
        .select(*key, "block", "set_id", "own", "grams")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def checked() -> dict[str, list]:
            """The links of one pair of blocks that no bucket of a lower band also has."""
            band, _, low, high = at
            names = [h[1] for h in held]
            sets = [np.frombuffer(h[3], np.uint64) for h in held]
            n = np.array([len(s) for s in sets])
            side = np.array([h[0] for h in held])
            mask = np.triu(np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n) - 1e-9, 1)
            if low != high:
                mask &= side[:, None] != side[None, :]
            hashes = np.array([[0 if x is None else x for x in h[2]] for h in held], np.int64)
            known = np.array([[x is not None for x in h[2]] for h in held])
            for k in range(band):
                mask &= ~((hashes[:, None, k] == hashes[None, :, k]) & known[:, None, k] & known[None, :, k])
            pairs = _similar(sets, mask, threshold)
            links = np.bincount(pairs.ravel(), minlength=len(names))
            parents = _forest(names, pairs)
            some = np.flatnonzero(links)
            return {
                "set_id": [names[i] for i in some],
                "links": links[some].tolist(),
                "parent": [parents[i] for i in some],
            }

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for *key_of, block_of, name, own_of, content in zip(*columns, strict=True):
                if key_of != at:
                    if len(held) > 1:
                        yield record(checked(), _FOUND_TYPES)
                    at, held = key_of, []
                held.append((block_of, name, own_of, content))
        if len(held) > 1:
            yield record(checked(), _FOUND_TYPES)

    return signed, materialize(tasks.mapInArrow(verify, _FOUND), "minhash-found")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, size: int = 5
) -> DataFrame:
    """Which documents are near duplicates by the Jaccard similarity of word n-grams.

    ``docs`` has ``doc_id, text``; other columns are not read. Returns one row per
    document: ``doc_id``, ``class_id`` (the smallest number that it hangs together with by
    similarities of at least ``threshold``), ``links`` (other n-gram sets that are similar
    to its own), ``copy_id`` and ``copies`` (the smallest number, and the number of
    documents, with the same set), ``text_key``, ``class_key`` (the text of the one that
    stands for the class).

    Documents with equal sets are one node, so copies are never expanded. Large buckets
    are split into blocks and the blocks compared pair by pair: a task sees two blocks and
    returns a row per set, so neither one task nor the output grows with the square of a
    group. A pair at the threshold is found with probability ``recall``, likelier above.

    Texts without words are copies of one another, a null text among them. Documents
    without a number come last within their class. Repeated rows are copies. Of no rows
    come no rows.
    """
    signed, found = similar_sets(docs, threshold, recall, size)
    edges = found.where("parent IS NOT NULL").select(F.col("set_id").alias("a"), F.col("parent").alias("b"))
    roots = components(edges)
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first")
    groups = (
        signed.groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("copies"), least)
        .join(roots, F.col("set_id") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "set_id"))
        .drop("node")
        .join(links, "set_id", "left")
        .where("copies > 1 OR links > 0")
    )
    groups = materialize(groups, "minhash-groups")
    classes = groups.groupBy("root").agg(F.min("first").alias("class"))
    groups = materialize(
        join_by_key(groups, classes, ["root"], "inner", ["set_id"]).select(
            "set_id",
            "copies",
            F.coalesce("links", F.lit(0)).alias("links"),
            F.col("first.doc_id").alias("copy_id"),
            F.col("class.doc_id").alias("class_id"),
            F.col("class.text_key").alias("class_key"),
        ),
        "minhash-classes",
    )
    alone = F.col("copies").isNull()
    return join_by_key(
        signed.select("doc_id", "set_id", "text_key"), groups, ["set_id"], "left", ["doc_id", "text_key"]
    ).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "text_key",
        F.coalesce("class_key", "text_key").alias("class_key"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, the smallest number."""
    marked = near_duplicates(docs, **options)
    names = ["_id", "_key"]

    def id_of(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_id")

    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    fates = materialize(
        marked.groupBy(id_of("doc_id"), F.col("text_key").alias("_key"))
        .agg(F.max(stays).alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("NOT kept OR n > 1"),
        "minhash-fates",
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), id_of("doc_id"), F.unhex(F.md5(text)).alias("_key"))
    return keep_rows(rows, fates, names)

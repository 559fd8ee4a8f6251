"""Ranked lexical search: the best documents for each query by Block-Max MaxScore.

Documents are indexed where they are read, a file of posting lists per shard. Lists are cut
into blocks, and a block's directory entry bounds what any of its postings can score. A
search takes a shard's documents in ascending order; lists that together cannot reach the
worst document kept so far propose no documents, and the bounds of their blocks reject most
of those that other lists propose before a block is decoded.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import open_file, record, rows, small, spread, write_file
from feedloom.operators.skew import fits_broadcast
from feedloom.session import materialize, scratch_path

# Postings in a block, and postings or documents in a shard.
BLOCK = 128
SHARD_POSTINGS = 4 << 20
SHARD_DOCS = 1 << 16

# Postings are told apart by how often their term stands in the document, up to these
# numbers, and a block knows the length of its shortest document of each kind: a term
# counts for more the more often it stands, and in a shorter document.
_KINDS = np.array([1, 2, 3, 4, 6, 9, 16])

# Terms are runs of digits, letters and anything beyond ASCII; only A to Z
# are lower-cased. In UTF-8 every byte beyond ASCII is 0x80 or more.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

_FILE = "path string, docs long, tokens long, term string, df long"
_FILE_TYPES = {"path": pa.string(), "docs": pa.int64(), "tokens": pa.int64(), "term": pa.string(), "df": pa.int64()}


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """A document's factor ``m`` from its number of terms."""
    if len(n) and 50 * int(n.max()) * total_docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * total_docs // total_terms for x in n], np.int64)
    return 50 + 50 * n.astype(np.int64) * total_docs // total_terms


def weight(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def _packed(arrays: dict[str, np.ndarray], body: bytes) -> bytes:
    table = json.dumps([[name, a.dtype.str, len(a)] for name, a in arrays.items()]).encode()
    return b"".join([len(table).to_bytes(8, "little"), table, *(a.tobytes() for a in arrays.values()), body])


def _unpacked(content: bytes) -> tuple[dict[str, np.ndarray], int]:
    at = 8 + int.from_bytes(content[:8], "little")
    arrays = {}
    for name, kind, n in json.loads(content[8:at]):
        arrays[name] = np.frombuffer(content, kind, n, at)
        at += arrays[name].nbytes
    return arrays, at


def encode_shard(
    doc_ids: list[int | None], lengths: list[int], held: list[int], codes: np.ndarray, tfs: np.ndarray, terms: list[bytes]
) -> bytes:
    """A shard's file. ``held`` counts the postings of each document; ``codes`` index ``terms``."""
    known = np.array([i is not None for i in doc_ids])
    numbers = np.array([i or 0 for i in doc_ids], np.int64)
    order = np.lexsort((numbers, ~known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = place[np.repeat(np.arange(len(order)), held)]
    sort = np.argsort(codes.astype(np.int64) << 32 | docs)
    codes, docs, tfs = codes[sort], docs[sort], tfs[sort].astype(np.int64)
    lengths = np.array(lengths, np.int64)[order]

    n = len(codes)
    first_of = np.flatnonzero(np.diff(codes, prepend=-1)) if n else np.zeros(0, np.int64)
    list_at = np.repeat(first_of, np.diff(np.append(first_of, n)))
    starts = np.flatnonzero((np.arange(n) - list_at) % BLOCK == 0)
    counts = np.diff(np.append(starts, n))
    block = np.repeat(np.arange(len(starts)), counts)
    local = np.arange(n) - starts[block]
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = 0

    def widths(values: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(values, starts) if n else values
        return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))

    gap_width, tf_width = widths(gaps), widths(tfs)
    ends = np.cumsum(counts * (gap_width + tf_width))
    offsets = ends - counts * (gap_width + tf_width)
    body = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    for values, width, base in ((gaps, gap_width, offsets), (tfs, tf_width, offsets + counts * gap_width)):
        for size in (1, 2, 4):
            mine = width[block] == size
            at = base[block[mine]] + local[mine] * size
            for k in range(size):
                body[at + k] = values[mine] >> 8 * k & 255

    shortest = np.full((len(_KINDS) + 1, len(starts)), 0xFFFFFFFF, np.int64)
    kind = np.searchsorted(_KINDS, tfs)
    for k in range(len(_KINDS) + 1):
        if n:
            shortest[k] = np.minimum.reduceat(np.where(kind == k, lengths[docs], 0xFFFFFFFF), starts)
    words = [terms[c] for c in codes[first_of]]
    return _packed(
        {
            "doc_ids": numbers[order].astype("<i8"),
            "known": known[order].astype("u1"),
            "lengths": np.minimum(lengths, 0xFFFFFFFF).astype("<u4"),
            "word_ends": np.cumsum([len(w) for w in words]).astype("<u8"),
            "words": np.frombuffer(b"".join(words), "u1"),
            "list_blocks": np.append(np.searchsorted(starts, first_of), len(starts)).astype("<u4"),
            "first": docs[starts].astype("<u4"),
            "last": docs[starts + counts - 1].astype("<u4"),
            "counts": counts.astype("u1"),
            "offsets": offsets.astype("<u8"),
            "gap_width": gap_width.astype("u1"),
            "tf_width": tf_width.astype("u1"),
            "most": (np.maximum.reduceat(tfs, starts) if n else tfs).astype("<u4"),
            "shortest": shortest.astype("<u4").ravel(),
        },
        body.tobytes(),
    )


class PostingList:
    """A term's postings in a shard; blocks are decoded when they are first asked for."""

    def __init__(self, shard: Shard, b0: int, b1: int):
        at = shard.at
        self._shard, self._b0 = shard, b0
        self.first, self.last = at["first"][b0:b1].astype(np.int64), at["last"][b0:b1].astype(np.int64)
        self._counts = at["counts"][b0:b1].astype(np.int64)
        most = at["most"][b0:b1].astype(np.int64)
        self.block_max = np.zeros(b1 - b0, np.int64)
        for k, shortest in enumerate(shard.shortest[:, b0:b1].astype(np.int64)):
            tf = np.minimum(most, _KINDS[k]) if k < len(_KINDS) else most
            there = shortest < 0xFFFFFFFF
            m = length_factor(shortest[there], *shard.totals)
            self.block_max[there] = np.maximum(self.block_max[there], impact(tf[there], m))
        #: No posting adds more than this to a score, for each unit of weight.
        self.most = int(self.block_max.max())
        self.decoded = np.zeros(b1 - b0, bool)
        # Blocks not decoded yet stand as their last document, which keeps the order.
        self.docs = np.repeat(self.last, self._counts)
        self.impacts = np.zeros(len(self.docs), np.int64)

    def decode(self, blocks: Iterator[int] | np.ndarray | range) -> None:
        at, content = self._shard.at, self._shard.content
        for b in blocks:
            if self.decoded[b]:
                continue
            self.decoded[b] = True
            i, count = b * BLOCK, int(self._counts[b])
            place = self._shard.body + int(at["offsets"][self._b0 + b])
            gap, tf = int(at["gap_width"][self._b0 + b]), int(at["tf_width"][self._b0 + b])
            docs = np.cumsum(np.frombuffer(content, f"<u{gap}", count, place), dtype=np.int64) + self.first[b]
            tfs = np.frombuffer(content, f"<u{tf}", count, place + gap * count).astype(np.int64)
            self.docs[i : i + count] = docs
            self.impacts[i : i + count] = impact(tfs, self._shard.m[docs])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` up to ``high`` and their impacts."""
        b0, b1 = np.searchsorted(self.last, low), np.searchsorted(self.first, high)
        self.decode(range(b0, b1))
        i, j = np.searchsorted(self.docs, (low, high))
        return self.docs[i:j], self.impacts[i:j]


class Shard:
    """A shard's file, opened for searches over a corpus of known totals."""

    def __init__(self, content: bytes, total_docs: int, total_terms: int):
        self.content, self.totals = content, (total_docs, total_terms)
        self.at, self.body = _unpacked(content)
        self.n_docs = len(self.at["doc_ids"])
        self.shortest = self.at["shortest"].reshape(len(_KINDS) + 1, -1)
        self.m = length_factor(self.at["lengths"], total_docs, total_terms) if total_terms else np.zeros(self.n_docs, np.int64)
        words, ends = self.at["words"].tobytes(), [0, *self.at["word_ends"].tolist()]
        self._places = {words[a:b]: i for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))}
        self._lists: dict[int, PostingList] = {}

    def postings(self, term: bytes) -> PostingList | None:
        place = self._places.get(term)
        if place is None:
            return None
        if place not in self._lists:
            b0, b1 = self.at["list_blocks"][place : place + 2]
            self._lists[place] = PostingList(self, int(b0), int(b1))
        return self._lists[place]

    def document(self, i: int) -> int | None:
        return int(self.at["doc_ids"][i]) if self.at["known"][i] else None


def best(
    shard: Shard, query: list[tuple[bytes, int]], k: int, floor: int = 0, window: int = 2048
) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a shard that score highest, above ``floor``: their places and scores.

    ``query`` has each term once with its weight. Documents are taken in ascending order, so
    of equal scores the lesser document is kept.
    """
    lists = [(p, w) for term, w in query if w > 0 and (p := shard.postings(term)) is not None]
    lists.sort(key=lambda x: x[0].most * x[1])
    bounds = np.cumsum([p.most * w for p, w in lists]) if lists else np.zeros(0, np.int64)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, shard.n_docs if lists else 0, window):
        high = min(low + window, shard.n_docs)
        # Lists before this one reach the floor not even together.
        essential = int(np.searchsorted(bounds, floor, side="right"))
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for p, w in lists[essential:]:
            docs, impacts = p.between(low, high)
            sums[docs - low] += w * impacts
        found = np.flatnonzero(sums)
        total = sums[found]
        found += low
        most = []
        for p, w in lists[:essential]:
            b = np.minimum(np.searchsorted(p.last, found), len(p.last) - 1)
            most.append(np.where((p.first[b] <= found) & (found <= p.last[b]), w * p.block_max[b], 0))
            total += most[-1]
        alive = np.flatnonzero(total > floor)
        for (p, w), bound in zip(reversed(lists[:essential]), reversed(most), strict=True):
            at = found[alive]
            bound = bound[alive]
            there = bound > 0
            p.decode(np.unique(np.searchsorted(p.last, at[there])))
            i = np.minimum(np.searchsorted(p.docs, at), len(p.docs) - 1)
            exact = np.where(there & (p.docs[i] == at), w * p.impacts[i], 0)
            total[alive] += exact - bound
            alive = alive[total[alive] > floor]
        if not len(alive):
            continue
        places, scores = np.append(places, found[alive]), np.append(scores, total[alive])
        keep = np.lexsort((places, -scores))[:k]
        places, scores = places[keep], scores[keep]
        if len(scores) == k:
            floor = max(floor, int(scores[-1]))
    return places, scores


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, folder: str | None = None) -> DataFrame:
    """Write the posting lists of ``doc_id, text`` as one file per shard of a task's rows.

    A null text has no terms. Only terms of ``vocabulary`` get lists, or all without it;
    lengths count all. A task starts a new file after ``SHARD_POSTINGS`` or ``SHARD_DOCS``,
    which bounds its memory. Returns for each file one row with its ``docs`` that have a term
    and their ``tokens``, ``term`` being null, and one with ``df`` for each of its terms.
    Names hold the task attempt: what a lost executor left behind is never read.
    """
    folder = folder or scratch_path(docs.sparkSession, "lexical")
    only = {w: i for i, w in enumerate(sorted(vocabulary))} if vocabulary is not None else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard = TaskContext.get(), 0
        codes_of: dict[bytes, int] = {} if only is None else only
        doc_ids, lengths, held, codes, tfs = [], [], [], [], []

        def flushed() -> pa.RecordBatch:
            path = f"{folder}/shard-{task.partitionId():06d}-{shard:04d}-{task.taskAttemptId()}.lex"
            all_codes = np.fromiter(chain.from_iterable(codes), np.int32)
            all_tfs = np.fromiter(chain.from_iterable(tfs), np.int32)
            words = list(codes_of)
            write_file(path, encode_shard(doc_ids, lengths, held, all_codes, all_tfs, words))
            dfs = np.bincount(all_codes, minlength=len(words))
            there = np.flatnonzero(dfs)
            return record(
                {
                    "path": [path] * (len(there) + 1),
                    "docs": [sum(n > 0 for n in lengths), *repeat(None, len(there))],
                    "tokens": [sum(lengths), *repeat(None, len(there))],
                    "term": [None, *(words[c].decode() for c in there)],
                    "df": [None, *dfs[there].tolist()],
                },
                _FILE_TYPES,
            )

        postings = 0
        for batch in small(batches):
            bodies = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), bodies, strict=True):
                tokens = terms_of(body or b"")
                if not tokens:
                    continue
                counted = Counter(tokens)
                if only is None:
                    here = list(counted)
                    codes.append([codes_of.setdefault(w, len(codes_of)) for w in here])
                else:
                    here = counted.keys() & only.keys()
                    codes.append([only[w] for w in here])
                tfs.append([counted[w] for w in here])
                doc_ids.append(doc_id)
                lengths.append(len(tokens))
                held.append(len(here))
                postings += len(here)
                if postings >= SHARD_POSTINGS or len(doc_ids) >= SHARD_DOCS:
                    yield flushed()
                    shard, postings = shard + 1, 0
                    doc_ids, lengths, held, codes, tfs = [], [], [], [], []
                    codes_of = {} if only is None else only
        if doc_ids:
            yield flushed()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(chosen.mapInArrow(write, _FILE), "lexical-files")


_QUERY_TYPES = {"query": pa.int64(), "item_id": pa.int64(), "term": pa.string()}


def _query_terms(items: DataFrame) -> DataFrame:
    """Each item's terms, one row for each: ``query, item_id, term``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            out: list[tuple] = []
            for row in batch.to_pylist():
                words = sorted(set(terms_of((row["text"] or "").encode())))
                out += [(row["query"], row["item_id"], w.decode()) for w in words]
            if out:
                yield record(dict(zip(_QUERY_TYPES, map(list, zip(*out, strict=True)), strict=True)), _QUERY_TYPES)

    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    numbered = distinct.withColumn("query", F.monotonically_increasing_id())
    return materialize(numbered.mapInArrow(split, "query long, item_id long, term string"), "lexical-queries")


_HIT = "query long, doc_id long, score long"
_HIT_TYPES = {"query": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}


def _search(
    files: DataFrame, queries: dict[int, list[tuple[bytes, int]]], floors: dict[int, int], k: int, total_docs: int, total_terms: int
) -> DataFrame:
    """The ``k`` best of every shard for every query, above the query's floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            with open_file(row["path"]) as file:
                shard = Shard(file.read(), total_docs, total_terms)
            for query, weighted in queries.items():
                places, scores = best(shard, weighted, k, floors.get(query, 0))
                if len(places):
                    ids = [shard.document(i) for i in places]
                    yield record({"query": [query] * len(ids), "doc_id": ids, "score": scores.tolist()}, _HIT_TYPES)

    return spread(files.select("path"), "path").mapInArrow(search, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, prime: int = 16, block_terms: int = 1 << 20) -> DataFrame:
    """The ``k`` documents of ``doc_id, text`` that score highest for each of ``item_id, text``.

    Terms, weights and scores are integers, see :func:`impact`, :func:`length_factor` and
    :func:`weight`; counts are over all documents. Returns ``item_id, rank, doc_id, score``
    with scores above 0, equal ones by ascending ``doc_id``, a missing one last. Equal rows
    of ``items`` count once; different texts of one ``item_id`` are ranked apart. Repeated
    documents are found as often as they are there. An item without terms has no rows.

    Items are taken in blocks of about ``block_terms`` terms. For each block some ``prime``
    shards are searched first; the least score that made it into an item's best there is a
    floor for all other shards, so these return few rows besides what is ranked in the end.
    """
    asked = _query_terms(items)
    distinct = asked.select("term").distinct()
    vocabulary = {row[0].encode() for row in distinct.collect()} if fits_broadcast(distinct) else None
    index = build_index(docs, vocabulary)
    total_docs, total_terms = index.where("term IS NULL").agg(
        F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))
    ).first()
    frequencies = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = materialize(asked.join(frequencies, "term"), "lexical-weights")
    files = index.where("term IS NULL")
    first = [row[0] for row in files.select("path").orderBy(F.xxhash64("path"), "path").limit(prime).collect()]
    primed = F.col("path").isin(first)

    blocks = -(-weighted.count() // block_terms)
    found = None
    for block in range(blocks):
        mine = weighted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for query, term, df in mine.select("query", "term", "df").collect():
            queries.setdefault(query, []).append((term.encode(), weight(total_docs, df)))
        start = materialize(_ranked(_search(files.where(primed), queries, {}, k, total_docs, total_terms), k), "lexical-first")
        full = start.where(F.col("rank") == k).select("query", "score").collect()
        floors = {query: score - 1 for query, score in full}
        rest = _search(files.where(~primed), queries, floors, k, total_docs, total_terms)
        hits = materialize(_ranked(start.drop("rank").unionByName(rest), k), "lexical-best")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _HIT).withColumn("rank", F.lit(0))
    names = asked.select("query", "item_id").distinct()
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")

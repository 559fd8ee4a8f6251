"""Shortest-pack-first packing of documents into sequences of a fixed length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import kept, record, small, texts
from feedloom.llm.tokens import encoder, stored_dtype
from feedloom.operators.skew import broadcast_if_small
from feedloom.session import materialize

_TOKENS = "doc_id long, ids binary, n long, part int, tail int, tail_rank long, full_before long"
_SLOTS = "tail int, from_rank long, to_rank long, tail_start int, length int, pack long, offset int"
_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_PIECE_TYPES = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
    "ids": pa.binary(),
}


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Place a histogram of lengths, longest first, each into the shortest open packs.

    A pack is opened when a length fits into none, while there are fewer packs than the
    tokens need in any case. After that such a length is cut at the largest free space
    and its rest goes back into the histogram, so all packs together have less than one
    pack's padding. Packs with the same free space lie in runs of consecutive numbers,
    and a whole count of a length goes to a whole run at once.

    Returns ``_SLOTS`` rows: of the documents whose tail has ``tail`` tokens, those ranked
    ``from_rank`` up to ``to_rank`` put ``length`` tokens from ``tail_start`` into the
    packs from ``pack`` on, at ``offset``. Runs and cut counts together never outnumber
    the lengths, so the rows are bounded by ``capacity``, not by the documents.
    """
    total = sum(length * count for length, count in histogram.items())
    opened, needed = 0, -(-total // capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    waiting = {length: [(length, 0, count, 0)] for length, count in histogram.items() if count}
    lengths = [-length for length in waiting]
    heapq.heapify(lengths)
    slots = []

    def push(table: dict, heap: list, key: int, item: tuple) -> None:
        if key not in table:
            table[key] = []
            heapq.heappush(heap, -key)
        table[key].append(item)

    while lengths:
        length = -heapq.heappop(lengths)
        for tail, rank, count, start in waiting.pop(length):
            while count:
                space = -spaces[0] if spaces else 0
                if length > space and opened < needed:
                    space, first, packs = capacity, opened, min(count, needed - opened)
                    opened += packs
                else:
                    first, packs = runs[space].pop()
                taken, size = min(packs, count), min(length, space)
                slots.append((tail, rank, rank + taken, start, size, first, capacity - space))
                if packs > taken:
                    runs[space].append((first + taken, packs - taken))
                elif space in runs and not runs[space]:
                    del runs[space]
                    heapq.heappop(spaces)
                if size < space:
                    push(runs, spaces, space - size, (first, taken))
                if size < length:
                    push(waiting, lengths, length - size, (tail, rank, taken, start + size))
                rank, count = rank + taken, count - taken
    return slots


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Cut and pack the tokens of ``doc_id, text`` into sequences of ``capacity``.

    Each document is encoded whole and ends with ``end_id``; a null text is empty. Its
    full multiples of ``capacity`` are sequences of their own. The rest, its tail, goes
    where `shortest_pack_first` puts the document with its rank among all tails of that
    length. Returns one row per piece: ``doc_id``, ``start`` in the document, ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and the piece's ``ids`` as
    unsigned little-endian 32-bit integers. Other columns of ``docs`` are not read.

    Tokens are written once. The writing task ranks its own tails while it goes, so the
    only shuffles are of one count per task and length. Repeated rows, rows without a
    number and ties are documents like any other; no rows give no pieces.
    """
    spark = docs.sparkSession

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        ranks, full = np.zeros(capacity, np.int64), 0
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in small(batches):
            ids = [found + end for found in encode.encode(texts(batch))]
            n = np.array([len(x) for x in ids], np.int64) // np.dtype(encode.dtype).itemsize
            tails, fulls = n % capacity, n // capacity
            rank = np.empty(len(n), np.int64)
            for i, tail in enumerate(tails):
                rank[i] = ranks[tail]
                ranks[tail] += 1
            before = full + np.cumsum(fulls) - fulls
            full += int(fulls.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ids, pa.binary()),
                    pa.array(n),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(tails.astype(np.int32)),
                    pa.array(rank),
                    pa.array(before),
                ],
                names=["doc_id", "ids", "n", "part", "tail", "tail_rank", "full_before"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    tokens = materialize(wanted.mapInArrow(tokenise, _TOKENS), "pack-tokens")

    counts = tokens.groupBy("part", "tail").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n") / capacity)).alias("full")
    )
    counts = materialize(counts, "pack-counts")
    histogram = {
        row["tail"]: row["n"]
        for row in counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()
    }
    slots = spark.createDataFrame(shortest_pack_first(histogram, capacity), _SLOTS)

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full = counts.groupBy("part").agg(F.sum("full").alias("full"))
    full = full.select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_offset"))
    packed_from = counts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    offsets = counts.select(
        "part",
        "tail",
        F.coalesce(F.sum("n").over(earlier.partitionBy("tail")), F.lit(0)).alias("rank_offset"),
    ).join(full, "part")

    placed = (
        tokens.join(broadcast_if_small(offsets), ["part", "tail"])
        .withColumn("rank", F.col("tail_rank") + F.col("rank_offset"))
        .withColumn("full_before", F.col("full_before") + F.col("full_offset"))
        .drop("part", "tail_rank", "rank_offset", "full_offset")
        .alias("t")
    )
    within = (
        (F.col("t.tail") == F.col("s.tail"))
        & (F.col("t.rank") >= F.col("s.from_rank"))
        & (F.col("t.rank") < F.col("s.to_rank"))
    )
    placed = placed.join(broadcast_if_small(slots).alias("s"), within, "left").select(
        "t.doc_id",
        "t.ids",
        "t.n",
        "t.full_before",
        "s.tail_start",
        "s.length",
        (F.lit(packed_from) + F.col("s.pack") + F.col("t.rank") - F.col("s.from_rank")).alias("pack"),
        F.col("s.offset").alias("offset"),
    )

    stored = stored_dtype(tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("packing",), dict)  # nothing, in the place of the encoder
        for batch in small(batches):
            found: dict[str, list] = {name: [] for name in _PIECE_TYPES}

            def piece(*values):
                for column, value in zip(found.values(), values, strict=True):
                    column.append(value)

            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                doc_id, ids, n, full_before, tail_start, length, pack_id, offset = row
                all_ids = np.frombuffer(ids, stored).astype("<u4")
                full = n // capacity
                if not tail_start:  # one row of a document, whatever its tail's pieces
                    for k in range(full):
                        at = k * capacity
                        own = all_ids[at : at + capacity].tobytes()
                        piece(doc_id, at, capacity, n, full_before + k, 0, own)
                if tail_start is not None:
                    at = full * capacity + tail_start
                    own = all_ids[at : at + length].tobytes()
                    piece(doc_id, at, length, n, pack_id, offset, own)
            yield record(found, _PIECE_TYPES)

    return placed.mapInArrow(cut, _PIECES)

"""Shards of new capacities, made from old ones by moving the fewest bytes.

A store is a table of documents in shards, each a chain of Parquet files. What each old shard
sends to each new one is the cheapest flow from shard sizes to capacities, so it is found
from one number per shard. A shard keeps the head of its chain; files behind the cut are read
and written anew, all others stay as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from feedloom.operators.skew import broadcast_if_small
from feedloom.session import materialize, scratch_path

# Bytes that a document takes besides its text.
OVERHEAD = 8


def _file() -> Column:
    """What names a row's file: the last three parts of its path, generation, shard and name."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -3)


@dataclass(frozen=True)
class Store:
    """Documents in shards. ``files`` has one row per file, ``rows`` the schema of the documents."""

    files: DataFrame
    rows: StructType
    shards: int
    generation: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def chained(self) -> DataFrame:
        """The files with their first slot and byte in the shard's chain."""
        before = Window.partitionBy("shard").orderBy("generation", "file").rowsBetween(Window.unboundedPreceding, -1)
        return self.files.withColumn("first_slot", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).withColumn(
            "first_byte", F.coalesce(F.sum("n_bytes").over(before), F.lit(0))
        )

    def sizes(self) -> list[int]:
        """Bytes in each shard."""
        held = dict(self.files.groupBy("shard").agg(F.sum("n_bytes")).collect())
        return [held.get(shard, 0) for shard in range(self.shards)]

    def read(self, files: DataFrame | None = None, columns: tuple[str, ...] = ("row",)) -> DataFrame:
        """Documents with their ``shard`` and ``slot``; ``row`` has a document's columns.

        ``files`` are rows of `chained`, by default all. Only folders that hold one of them
        are read.
        """
        files = self.chained() if files is None else files
        schema = StructType().add("row", self.rows).add("size", "long")
        folders = [r[0] for r in files.select("folder").distinct().collect()]
        if not folders:
            empty = self.spark.createDataFrame([], schema.add("shard", "integer").add("slot", "long"))
            return empty.select(*columns, "size", "shard", "slot")
        wanted = broadcast_if_small(files.select(F.col("file").alias("_file"), "shard", "first_slot"))
        placed = self.spark.read.schema(schema).parquet(*folders).select(
            *columns, "size", _file().alias("_file"), F.col("_metadata.row_index").alias("_at")
        )
        slot = F.col("first_slot") + F.col("_at")
        return placed.join(wanted, "_file").select(*_names(columns), "size", "shard", slot.alias("slot"))


def _names(columns: tuple[str, ...]) -> list[str]:
    return [column.rpartition(".")[2] for column in columns]


def size_of(text: Column) -> Column:
    """Bytes of a document: its text in UTF-8, none if null, and ``OVERHEAD``."""
    return F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long") + OVERHEAD


def _write(rows: DataFrame, root: str, generation: int, order: list[str]) -> DataFrame:
    """Write ``row, size, shard`` as files of one shard each; returns their rows of ``Store.files``.

    Rebalancing brings a shard's rows together and cuts a large shard into several files.
    """
    folder = f"{root}/generation={generation}"
    (
        rows.hint("rebalance", "shard")
        .sortWithinPartitions("shard", *order)
        .select("row", "size", "shard")
        .write.partitionBy("shard")
        .parquet(folder)
    )
    spark = rows.sparkSession
    schema = StructType().add("size", "long").add("shard", "integer")
    written = spark.read.schema(schema).parquet(folder).select("shard", "size", _file().alias("file"))
    counted = written.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    place = F.concat(F.lit(f"{folder}/shard="), F.col("shard").cast("string"))
    return counted.select("shard", F.lit(generation).alias("generation"), place.alias("folder"), "file", "n_rows", "n_bytes")


def lay_out(docs: DataFrame, shards: int, shard: Column, folder: str | None = None) -> Store:
    """Write ``doc_id, text`` and all other columns as a store; ``shard`` gives a row's shard."""
    root = folder or scratch_path(docs.sparkSession, "shards")
    rows = docs.select(F.struct("*").alias("row"), size_of(F.col("text")).alias("size"), shard.cast("int").alias("shard"))
    rows = rows.withColumn("_order", F.col("row.doc_id"))
    files = materialize(_write(rows, root, 0, ["_order"]), "shard-files")
    return Store(files, docs.schema, shards)


def near_equal(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most and add up to ``total``."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def cheapest_flow(
    supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, at least cost; capacities must suffice.

    Successive shortest paths with potentials: each round sends as much as fits along the
    cheapest way from shards with bytes left to shards with room, where bytes already placed
    may be placed anew. Its work depends on the numbers of shards alone.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are less than what there is")
    m, n = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    price = [0] * (m + n)
    while any(left):
        far = [None] * (m + n)
        came: list[int | None] = [None] * (m + n)
        queue = [(0, i) for i in range(m) if left[i]]
        seen: dict[int, int] = {i: 0 for _, i in queue}
        end = None
        while queue:
            d, v = heapq.heappop(queue)
            if far[v] is not None:
                continue
            far[v] = d
            if v >= m and room[v - m] and end is None:
                end = v
                break
            if v < m:
                steps = ((m + j, cost(v, j)) for j in range(n))
            else:
                steps = ((i, -cost(i, v - m)) for i in range(m) if flow.get((i, v - m)))
            for to, c in steps:
                at = d + c + price[v] - price[to]
                if far[to] is None and at < seen.get(to, at + 1):
                    seen[to], came[to] = at, v
                    heapq.heappush(queue, (at, to))
        reached = far[end]
        price = [p + (reached if d is None else min(d, reached)) for p, d in zip(price, far, strict=True)]
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        most = min(left[path[0]], room[end - m])
        for a, b in zip(path, path[1:], strict=False):
            if a >= m:
                most = min(most, flow[b, a - m])
        for a, b in zip(path, path[1:], strict=False):
            edge, sign = ((a, b - m), 1) if a < m else ((b, a - m), -1)
            flow[edge] = flow.get(edge, 0) + sign * most
        left[path[0]] -= most
        room[end - m] -= most
    return {edge: f for edge, f in flow.items() if f}


@dataclass(frozen=True)
class Piece:
    """Slots ``first`` up to ``end`` of an old shard, which go to a new one."""

    old: int
    new: int
    first: int
    end: int
    n_bytes: int


def _boundaries(store: Store, chained: DataFrame, cuts: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For each (shard, byte): documents that end there or before and their bytes, and
    documents that begin before it and their bytes.

    Only files in which a cut lies are read, and of them only the sizes.
    """
    spark = store.spark
    at = F.broadcast(spark.createDataFrame(cuts, "shard int, cut long"))
    last = F.col("first_byte") + F.col("n_bytes")
    hit = materialize(
        chained.join(at, "shard").where((F.col("first_byte") < F.col("cut")) & (F.col("cut") <= last)), "shard-cuts"
    )
    files = hit.drop("cut").distinct()
    sizes = store.read(files, columns=()).join(F.broadcast(at), "shard")
    first = F.broadcast(hit.select("shard", "cut", F.col("first_slot").alias("_first"), (F.col("first_slot") + F.col("n_rows")).alias("_end"), "first_byte"))
    mine = sizes.join(first, ["shard", "cut"]).where("slot >= _first AND slot < _end")
    before = Window.partitionBy("shard", "cut").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = mine.withColumn("_to", F.col("first_byte") + F.sum("size").over(before))
    ended, begun = F.col("_to") <= F.col("cut"), F.col("_to") - F.col("size") < F.col("cut")
    found = run.groupBy("shard", "cut").agg(
        (F.first("_first") + F.count_if(ended)).alias("ended"),
        (F.first("first_byte") + F.coalesce(F.sum(F.when(ended, F.col("size"))), F.lit(0))).alias("ended_bytes"),
        (F.first("_first") + F.count_if(begun)).alias("begun"),
        (F.first("first_byte") + F.coalesce(F.sum(F.when(begun, F.col("size"))), F.lit(0))).alias("begun_bytes"),
    )
    return {(r.shard, r.cut): tuple(r[2:]) for r in found.collect()}


def transfers(store: Store, capacities: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> list[Piece]:
    """The cheapest flow in whole documents: for each old shard its pieces in order.

    The piece that stays comes first and never has more bytes than the flow keeps; each
    other piece begins with the first document that begins in its part of the chain. No
    piece is off by more than one document at either end.
    """
    sizes, chained = store.sizes(), store.chained()
    flow = cheapest_flow(sizes, capacities, cost)
    goes = {i: sorted((j != i, j, flow[i, j]) for j in range(len(capacities)) if (i, j) in flow) for i in range(store.shards)}
    cuts = []
    for old, out in goes.items():
        at = 0
        for _, _, n in out[:-1]:
            at += n
            cuts.append((old, at))
    found = _boundaries(store, chained, cuts) if cuts else {}
    rows = dict(store.files.groupBy("shard").agg(F.sum("n_rows")).collect())
    pieces = []
    for old, out in goes.items():
        at = first = first_byte = 0
        for moved, new, n in out:
            at += n
            if at == sizes[old]:
                end, end_byte = rows.get(old, 0), sizes[old]
            else:
                ended, ended_bytes, begun, begun_bytes = found[old, at]
                end, end_byte = (begun, begun_bytes) if moved else (ended, ended_bytes)
            pieces.append(Piece(old, new, first, end, end_byte - first_byte))
            first, first_byte = end, end_byte
    return pieces


def _levelled(
    store: Store, chained: DataFrame, pieces: list[Piece], capacities: list[int], free: int
) -> list[tuple[int, int, int]]:
    """Where the last ``free`` documents of each piece that moves go, as (shard, slot, new shard).

    They are dealt longest first to the shard with most room, which evens out what cutting
    at whole documents left uneven. There are at most ``free`` times as many as pieces.
    """
    tails = [(p.old, max(p.first, p.end - free), p.end) for p in pieces if p.old != p.new and p.end > p.first]
    if not tails:
        return []
    spans = F.broadcast(store.spark.createDataFrame(tails, "shard int, low long, high long"))
    inside = (F.col("first_slot") < F.col("high")) & (F.col("first_slot") + F.col("n_rows") > F.col("low"))
    files = materialize(chained.join(spans, "shard").where(inside).drop("low", "high").distinct(), "shard-tails")
    tail = store.read(files, columns=()).join(spans, "shard").where("slot >= low AND slot < high")
    docs = [tuple(r) for r in tail.select("size", "shard", "slot").collect()]
    room = list(capacities)
    for p in pieces:
        room[p.new] -= p.n_bytes
    home = {}
    for p in pieces:
        for _, shard, slot in (d for d in docs if d[1] == p.old and p.first <= d[2] < p.end):
            home[shard, slot] = p.new
    for size, shard, slot in docs:
        room[home[shard, slot]] += size
    queue = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(queue)
    out = []
    for size, shard, slot in sorted(docs, key=lambda d: (-d[0], d[1:])):
        r, j = heapq.heappop(queue)
        out.append((shard, slot, j))
        heapq.heappush(queue, (r + size, j))
    return out


def reshard(
    store: Store,
    capacities: list[int],
    cost: Callable[[int, int], int] = lambda i, j: int(i != j),
    free: int = 1024,
    folder: str | None = None,
) -> Store:
    """The store in as many shards as there are ``capacities``, in bytes.

    ``cost(old, new)`` is what moving a byte costs, by default 1 between different shards,
    so that the fewest bytes move. Old shards that are too large keep the head of their
    chain. Files with none but such rows are taken over; the others are read once, and their
    rows written behind what the new shards keep. `vacuum` deletes the files they were in.

    Shards differ from their capacities by less than a document where moving ones include
    short ones: the last ``free`` documents of each transfer go wherever room is left, at
    whatever cost, and even them out. Every row
    is in one shard, whatever its columns hold; equal rows are rows of their own. A store
    without rows has no files before and after.
    """
    chained = store.chained()
    pieces = transfers(store, capacities, cost)
    levelled = _levelled(store, chained, pieces, capacities, free)
    kept = {p.old: p.end for p in pieces if p.old == p.new}
    spark = store.spark
    heads = F.broadcast(spark.createDataFrame([(i, kept.get(i, 0)) for i in range(store.shards)], "shard int, kept long"))
    split = materialize(chained.join(heads, "shard"), "shard-split")
    whole = F.col("first_slot") + F.col("n_rows") <= F.col("kept")
    stay = split.where(whole).select(*store.files.columns)
    touched = split.where(~whole).drop("kept")
    # At most one piece for each old and new shard, and `free` documents for each piece.
    spans = spark.createDataFrame([(p.old, p.first, p.end, p.new) for p in pieces if p.end > p.first], "shard int, low long, high long, new int")
    dealt = spark.createDataFrame(levelled, "shard int, slot long, to int")
    rows = store.read(touched).join(F.broadcast(spans), "shard").where("slot >= low AND slot < high")
    moved = rows.join(F.broadcast(dealt), ["shard", "slot"], "left").select(
        "row", "size", F.coalesce("to", "new").alias("shard"), F.col("shard").alias("_old"), "slot"
    )
    moved = moved.withColumn("_moved", F.col("shard") != F.col("_old"))
    generation = store.generation + 1
    root = folder or scratch_path(spark, "shards")
    fresh = _write(moved, root, generation, ["_moved", "_old", "slot"])
    files = materialize(stay.unionByName(fresh), "shard-files")
    return replace(store, files=files, shards=len(capacities), generation=generation)


def vacuum(old: Store, new: Store) -> int:
    """Delete the files of ``old`` that ``new`` no longer has; returns how many there were.

    For once nothing reads the old store any more. A file is named by its place, one at a
    time, as they are taken from the list.
    """
    spark, gone = old.spark, 0
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder, file in old.files.join(new.files, "file", "left_anti").select("folder", "file").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file.rpartition('/')[2]}")
        gone += path.getFileSystem(hadoop).delete(path, False)
    return gone

"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import spread
from feedloom.session import materialize

_INDEX = (
    "dim int, shard int, node int, entry boolean, class_id long, members array<long>,"
    " embedding array<float>, neighbours array<int>"
)
_FOUND = "query_id long, query_class long, vec_id long, score double"


def _squared(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each row's ``ids`` to its point; infinite where an id is -1."""
    dots = np.einsum("qrd,qd->qr", vectors[ids], points)
    squared = norms[ids] - 2 * dots + (points * points).sum(1)[:, None]
    return np.where(ids < 0, np.inf, np.maximum(squared, 0))


class Graph:
    """A directed graph over distinct vectors; ``edges`` has a row of neighbours per node."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.norms = (self.vectors * self.vectors).sum(1)
        self.edges, self.entry = edges, entry

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy searches from the entry, many at once.

        Each step expands the nearest node of each beam that is not yet expanded; a search
        ends when its whole beam is. Returns (beams, expanded): node numbers, -1 where
        there are fewer.
        """
        count = len(points)
        ids = np.full((count, beam), -1, np.int64)
        dist = np.full((count, beam), np.inf, np.float32)
        done = np.zeros((count, beam), bool)
        ids[:, 0] = self.entry
        dist[:, 0] = _squared(self.vectors, self.norms, ids[:, :1], points)[:, 0]
        trail = []
        while True:
            open_ = ~done & (ids >= 0)
            active = np.flatnonzero(open_.any(1))
            if not len(active):
                break
            at = open_[active].argmax(1)  # beams are sorted by distance
            node = ids[active, at]
            done[active, at] = True
            step = np.full(count, -1, np.int64)
            step[active] = node
            trail.append(step)
            near = self.edges[node].astype(np.int64)
            near[(near[:, :, None] == ids[active][:, None, :]).any(2)] = -1
            new = _squared(self.vectors, self.norms, near, points[active])
            all_ids = np.concatenate([ids[active], near], 1)
            all_dist = np.concatenate([dist[active], new.astype(np.float32)], 1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            dist[active] = np.take_along_axis(all_dist, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
        return ids, np.stack(trail, 1)

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """Robust pruning: the nearest candidate stays, and those much nearer to it go.

        A candidate goes when ``alpha`` times its distance to one that stays is no more
        than its distance to the node, which keeps edges in diverse directions.
        """
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        # Each candidate once, nearest first.
        ordered = np.sort(candidates, 1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        dist = _squared(self.vectors, self.norms, ordered, self.vectors[nodes])
        best = np.argsort(dist, axis=1, kind="stable")[:, : 4 * degree]
        ids, dist = np.take_along_axis(ordered, best, 1), np.take_along_axis(dist, best, 1)
        points = self.vectors[ids]
        between = self.norms[ids][:, :, None] + self.norms[ids][:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        alive, row = ids >= 0, np.arange(len(nodes))
        out = np.full((len(nodes), degree), -1, np.int32)
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[some, k] = ids[row, pick][some]
            alive &= ~(alpha * alpha * between[row, pick] <= dist)
            alive[row, pick] = False
        return out

    def build(self, degree: int, beam: int, alpha: float, batch: int = 256, seed: int = 0) -> None:
        """Two passes over all nodes, the second with relaxed pruning.

        A greedy search for each node proposes neighbours among what it expands; the
        pruned ones become its edges, and edges back are added and pruned in turn.
        """
        n, rng = len(self.vectors), np.random.default_rng(seed)
        mean = self.vectors.mean(0)
        self.entry = int(((self.vectors - mean) ** 2).sum(1).argmin())
        wide = degree + degree // 2
        self.edges = np.full((n, wide), -1, np.int32)
        if n > 1:
            self.edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        for relaxed in (1.0, alpha):
            order = rng.permutation(n)
            for first in range(0, n, batch):
                nodes = order[first : first + batch]
                _, expanded = self.search(self.vectors[nodes], beam)
                candidates = np.concatenate([expanded, self.edges[nodes]], 1)
                self.edges[nodes, :degree] = self.pruned(nodes, candidates, relaxed, degree)
                self.edges[nodes, degree:] = -1
                self._add_back(nodes, relaxed, degree)

    def _add_back(self, nodes: np.ndarray, alpha: float, degree: int) -> None:
        to, back = self.edges[nodes].ravel().astype(np.int64), np.repeat(nodes, self.edges.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        new = ~(self.edges[to] == back[:, None]).any(1)
        order = np.argsort(to[new], kind="stable")
        to, back = to[new][order], back[new][order]
        if not len(to):
            return
        begins = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        rank = np.arange(len(to)) - np.repeat(begins, np.diff(np.append(begins, len(to))))
        # Neighbours fill a row from the left, so the first free place is their number.
        place = (self.edges[to] >= 0).sum(1) + rank
        fits = place < self.edges.shape[1]
        self.edges[to[fits], place[fits]] = back[fits]
        full, slot = np.unique(to[~fits], return_inverse=True)
        if len(full):
            over = place[~fits] - self.edges.shape[1]
            more = np.full((len(full), int(over.max()) + 1), -1, np.int64)
            more[slot, over] = back[~fits]
            candidates = np.concatenate([self.edges[full], more], 1)
            self.edges[full, :degree] = self.pruned(full, candidates, alpha, degree)
            self.edges[full, degree:] = -1


def usable(embedding: str = "embedding"):
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(
    vectors: DataFrame, k: int, degree: int = 32, beam: int = 64, alpha: float = 1.2, shard_rows: int = 8192
) -> DataFrame:
    """Graphs over all vectors of ``vec_id, embedding``, written to the shared folder.

    Equal vectors are one node, however many they are. A node keeps the ``k + 1`` smallest
    numbers of its vectors, which is all that a search for ``k`` neighbours with ties to
    the smaller number can return. Nodes are dealt by hash into as many shards as hold
    about ``shard_rows`` each, per number of dimensions; a task builds one shard's graph.
    """
    clean = vectors.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("float")).alias("embedding"),
    ).distinct()
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    classes = (
        clean.withColumn("rank", F.row_number().over(smallest))
        .where(F.col("rank") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
        .select(F.size("embedding").alias("dim"), F.get("members", F.lit(0)).alias("class_id"), "members", "embedding")
    )
    classes = materialize(classes, "ann-classes")
    shards = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        order = np.argsort(table.column("class_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        graph = Graph(_matrix(table.column("embedding"), dim))
        graph.build(degree, beam, alpha)
        n = table.num_rows
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * graph.edges.shape[1], graph.edges.shape[1], dtype=np.int32)),
            pa.array(graph.edges.ravel()),
        )
        return pa.table(
            {
                "dim": pa.array(np.full(n, dim, np.int32)),
                "shard": table.column("shard"),
                "node": pa.array(np.arange(n, dtype=np.int32)),
                "entry": pa.array(np.arange(n) == graph.entry),
                "class_id": table.column("class_id"),
                "members": table.column("members"),
                "embedding": table.column("embedding"),
                "neighbours": lists,
            }
        )

    # As many rows as there are numbers of dimensions.
    dealt = classes.join(shards, "dim").withColumn(
        "shard", F.pmod(F.xxhash64("class_id", F.hash("embedding")), "shards").cast("int")
    )
    return materialize(
        spread(dealt.select("dim", "shard", "class_id", "members", "embedding"), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX),
        "ann-index",
    )


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = 128, block: int = 4096) -> DataFrame:
    """The ``k`` nearest vectors found for each of ``vec_id, embedding``, but for itself.

    Queries meet every shard of their dimensions in blocks of about ``block``; a task
    searches one shard for one block. Nearness is the Euclidean distance in double
    precision on the vectors as given, ties go to the smaller ``vec_id``. Returns
    ``query_id, rank, vec_id, score``. Queries that are not `usable` find nothing. A
    number that stands for several vectors asks for each of them, told apart by
    ``query_class``.
    """
    clean = queries.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("query_id"),
        F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("float")).alias("point"),
    ).distinct()
    clean = clean.withColumn("dim", F.size("point")).withColumn("query_class", F.xxhash64("point"))
    counts = clean.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    known = materialize(counts.join(shards, "dim"), "ann-blocks")
    asked = (
        clean.join(known, "dim")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("dim", "shard", "block", "query_id", "query_class", "point")
    )
    held = index.join(known, "dim").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    ).select("dim", "shard", "block", "node", "entry", "members", "embedding", "neighbours")

    def search(key: tuple, nodes: pa.Table, asking: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        columns: tuple = ([], [], [], [])
        if nodes.num_rows and asking.num_rows:
            nodes = nodes.take(pa.array(np.argsort(nodes.column("node").to_numpy())))
            vectors = _matrix(nodes.column("embedding"), dim)
            edges = _matrix(nodes.column("neighbours"), len(nodes.column("neighbours")[0]))
            graph = Graph(vectors, edges, int(np.flatnonzero(nodes.column("entry").to_numpy())[0]))
            members = nodes.column("members").to_pylist()
            points = _matrix(asking.column("point"), dim)
            names, classes = (asking.column(c).to_pylist() for c in ("query_id", "query_class"))
            for first in range(0, len(names), 256):
                some = points[first : first + 256]
                beams, _ = graph.search(some, beam)
                for at, own in enumerate(beams):
                    own = own[own >= 0]
                    gaps = vectors[own].astype(np.float64) - some[at].astype(np.float64)
                    far = np.sqrt((gaps * gaps).sum(1))
                    me = names[first + at]
                    near = sorted((d, i) for d, c in zip(far.tolist(), own, strict=True) for i in members[c] if i != me)
                    for d, i in near[:k]:
                        for column, value in zip(columns, (me, classes[first + at], i, d), strict=True):
                            column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            {n: pa.array(c, t) for n, c, t in zip(("query_id", "query_class", "vec_id", "score"), columns, kinds, strict=True)}
        )

    key = ["dim", "shard", "block"]
    found = spread(held, *key).groupBy(*key).cogroup(spread(asked, *key).groupBy(*key)).applyInArrow(search, _FOUND)
    best = Window.partitionBy("query_id", "query_class").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """Index ``vectors`` and search it for ``queries``: `build_index` and `search_index`."""
    return search_index(build_index(vectors, k, **options), queries, k)

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import join_by_key
from feedloom.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours above a node, then those below, move to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    large = (
        join_by_key(both.where("b > a"), least, ["a"], "inner", ["b"])
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )
    # Every edge now goes from the larger node down.
    large = materialize(large, "components-large")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_by_key(large, least, ["a"], "inner", ["b"]).where("b <> m")
    small = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b"))
    return materialize(small.unionByName(kept).distinct(), "components-small")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node.

    Each round writes its edges to the shared folder and the number of rounds grows with
    the logarithm of the longest path. Nodes that many edges share are split in the joins.
    """

    def state(table: DataFrame) -> tuple:
        hashed = F.xxhash64("a", "b")
        return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(hashed)).first())

    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "components")
    before, seen = None, state(now)
    while seen != before:
        now = _stars(now)
        before, seen = seen, state(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

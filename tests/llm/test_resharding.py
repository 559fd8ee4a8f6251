import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm.resharding import cheapest_flow, lay_out, near_equal, reshard, size_of, vacuum
from feedloom.session import path_exists


def least_cost(supply, capacity, cost):
    """The cost of the best flow, by trying every way to deal out units."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    least = None
    for to in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(to.count(j) <= c for j, c in enumerate(capacity)):
            total = sum(cost(i, j) for i, j in zip(units, to, strict=True))
            least = total if least is None else min(least, total)
    return least


def test_flow_against_all_ways():
    chance = random.Random(1)
    for _ in range(60):
        supply = [chance.randrange(3) for _ in range(3)]
        capacity = [chance.randrange(4) for _ in range(chance.randrange(1, 4))]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        prices = [[chance.randrange(6) for _ in capacity] for _ in supply]
        flow = cheapest_flow(supply, capacity, lambda i, j: prices[i][j])
        for i, n in enumerate(supply):
            assert sum(f for (a, _), f in flow.items() if a == i) == n
        for j, n in enumerate(capacity):
            assert sum(f for (_, b), f in flow.items() if b == j) <= n
        assert sum(prices[i][j] * f for (i, j), f in flow.items()) == least_cost(supply, capacity, lambda i, j: prices[i][j])
    with pytest.raises(ValueError):
        cheapest_flow([3], [1, 1])


def test_flow_moves_what_does_not_fit():
    chance = random.Random(2)
    supply = [chance.randrange(10**12) for _ in range(40)]
    capacity = near_equal(sum(supply), 64)
    flow = cheapest_flow(supply, capacity)
    moved = sum(f for (i, j), f in flow.items() if i != j)
    assert moved == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=False))


def bag(df):
    return Counter(map(repr, df.collect()))


def check(docs, store, capacities, **options):
    old = Counter((r.shard, repr(r.row), r["size"]) for r in store.read().collect())
    new = reshard(store, capacities, **options)
    read = new.read().collect()
    assert bag(new.read().select("row.*")) == bag(docs)
    per_shard = {}
    for r in read:
        per_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in held) == list(range(len(held))) for held in per_shard.values())
    assert set(per_shard) <= set(range(len(capacities)))
    assert new.sizes() == [sum(r["size"] for r in per_shard.get(j, [])) for j in range(len(capacities))]
    longest = max((r["size"] for r in read), default=0)
    # No more moves than has to, but for documents at cuts.
    left = Counter((r.shard, repr(r.row), r["size"]) for r in read)
    stayed = sum(size * n for (_, _, size), n in (old & left).items())
    must = sum(max(0, s - c) for s, c in zip(store.sizes(), capacities + [0] * len(store.sizes()), strict=False))
    if not options:
        assert sum(r["size"] for r in read) - stayed <= must + (len(capacities) + store.shards) * longest
    return new, longest


def some_docs(spark, n=3000, seed=1):
    chance = random.Random(seed)
    rows = [(i, "é" * chance.choice([0, 1, 5, 50, 500]), f"s{min(chance.randrange(12), chance.randrange(12))}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def by_source():
    return F.pmod(F.xxhash64("source"), F.lit(7))


def test_growing_shrinking_and_unequal_shards(spark):
    docs = some_docs(spark)
    store = lay_out(docs, 7, by_source())
    total = sum(store.sizes())
    for capacities in (near_equal(total, 11), near_equal(total, 3), [0, total // 2, 0, total - total // 2]):
        new, longest = check(docs, store, capacities)
        assert all(abs(s - c) <= 8 + 2 for s, c in zip(new.sizes(), capacities, strict=True) if len(capacities) != 4)
    again, _ = check(docs, new, near_equal(total, 5))
    assert max(again.sizes()) - min(again.sizes()) <= 10


def test_files_without_moved_rows_are_taken_over(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    docs = some_docs(spark).repartition(12)
    spark.conf.set(name, "2k")
    try:
        store = lay_out(docs, 2, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
        new, _ = check(docs, store, near_equal(sum(store.sizes()), 3))
    finally:
        spark.conf.set(name, before)
    old_files = {r.file for r in store.files.collect()}
    taken = {r.file for r in new.files.collect() if r.generation == 0}
    assert len(old_files) > 10 and taken < old_files and len(taken) > len(old_files) / 2
    folder = {r.file: r.folder for r in store.files.collect()}
    assert vacuum(store, new) == len(old_files - taken)
    assert bag(new.read().select("row.*")) == bag(docs)
    for file in old_files:
        assert path_exists(spark, f"{folder[file]}/{file.rpartition('/')[2]}") == (file in taken)


def test_moves_follow_their_cost(spark):
    docs = some_docs(spark, 600)
    store = lay_out(docs, 3, F.pmod(F.col("doc_id"), F.lit(3)))
    total = sum(store.sizes())
    # Shards 0 and 3, 1 and 4, 2 and 5 are neighbours; anything else is dear.
    new, longest = check(docs, store, near_equal(total, 6), free=8, cost=lambda i, j: 0 if i == j else 1 if i % 3 == j % 3 else 100)
    far = new.read().where(F.pmod(F.col("row.doc_id"), F.lit(3)) != F.col("shard") % 3)
    assert far.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= total / 6


def test_odd_documents(spark, cases):
    docs = cases.docs()
    store = lay_out(docs, 4, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)))
    assert store.sizes() == [
        docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == i).agg(F.sum(size_of(F.col("text")))).first()[0] for i in range(4)
    ]
    check(docs, store, near_equal(sum(store.sizes()), 6))


def test_nothing_to_move_and_no_documents(spark, cases):
    docs = some_docs(spark, 100)
    store = lay_out(docs, 2, F.pmod(F.col("doc_id"), F.lit(2)))
    same, _ = check(docs, store, store.sizes())
    assert {r.file for r in same.files.collect()} == {r.file for r in store.files.collect()}
    assert vacuum(store, same) == 0
    empty = lay_out(cases.empty(), 3, F.lit(0))
    check(cases.empty(), empty, near_equal(0, 5))

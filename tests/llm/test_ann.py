import numpy as np
from pyspark.sql import functions as F

from feedloom.llm.ann import nearest


def brute(vectors, k):
    found = {}
    for q, point in vectors:
        gaps = sorted((float(np.sqrt(((np.float64(v) - np.float64(point)) ** 2).sum())), i) for i, v in vectors if i != q and len(v) == len(point))
        found[q] = gaps[:k]
    return found


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=16).astype(np.float32)) for i in range(1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<float>")
    out = nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_rows=400).collect()
    exact = brute(vectors, 10)
    hits = sum((r.vec_id in {i for _, i in exact[r.query_id]}) for r in out)
    assert len(out) == 750 and hits / 750 >= 0.95
    points = dict(vectors)
    for r in out[:50]:
        gap = np.float64(points[r.query_id]) - np.float64(points[r.vec_id])
        assert abs(r.score - np.sqrt((gap * gap).sum())) < 1e-12


def test_edges(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(40 + i, [1.0, float(i + 1), 0.0]) for i in range(5)]
    rows += [
        (100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 0.0]), (103, [float("inf"), 1.0, 0.0]),
        (104, [1.0, None, 0.0]), (105, []), (None, [1.0, 2.0, 3.0]), (106, [1.0, 1.0]), (107, [1.0, -0.0, 0.0]), (3, same),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("*", *(F.lit(7).alias(c) for c in ("dim", "shard", "rank", "members", "block", "score")))
    out = nearest(df, df, k=4, shard_rows=3).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    assert by[2] == [(0, 0.0), (1, 0.0), (3, 0.0), (4, 0.0)] and by[107][0] == (0, 0.0)
    assert by[41][:2] == [(40, 1.0), (42, 1.0)]
    assert not set(by) & {100, 101, 102, 103, 104, 105, None} and 106 not in by
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(two, two.where("vec_id = 1")).collect()] == [(1, 1, 2, 1.0)]

import numpy as np

from pagewright.llm import topk
from pyspark.sql import functions as F


def brute(rows, queries, k, scale=64):
    whole = [(i, np.floor(scale * np.array(v, dtype=float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = {}
    for q in queries:
        own = [v for i, v in whole if i == q]
        if own:
            vector = min(own, key=lambda v: v.tolist())
            scored = sorted((-int(v @ vector), i) for i, v in whole if i != q and len(v) == len(vector))
            found[q] = [(i, -s) for s, i in scored[:k]]
    return found


def run(spark, rows, k=5, **settings):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k=k, **settings).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def test_trees_and_blocks_match_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(draw.normal(size=6), 1)]) for i in range(400)]
    expected = {q: v for q, v in brute(rows, range(0, 400, 10), 5).items() if v}
    assert run(spark, rows) == expected
    assert run(spark, rows, block=7, shard_rows=50, leaf=8, sample=0) == expected


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, [1.0, 2.0, 3.0]), (60, []), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [1.0, 1.0])]
    found = run(spark, rows)
    assert found == {0: [(1, 20480), (2, 20480), (3, 6144), (3, 6144)]}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold():
    """No bound is under a product of its node, with zero and very long vectors too."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(100, 16))
    for near in (0.1, 10.0):
        rows = np.floor(64 * (centres[draw.integers(0, 100, 4000)] + near * draw.normal(size=(4000, 16)))).astype(np.int64)
        rows[:3] = 0
        rows[3] *= 2**40
        queries = np.concatenate([rows[::20], -rows[1:40:3]])
        tree = topk.BallTree(rows, 32)
        bounds, products = tree.bounds(queries, rows=64), queries.astype(float) @ rows.T.astype(float)
        for node, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)):
            highest = products[:, tree.order[a:b]].max(axis=1)
            assert (bounds[:, node] >= highest - 1e-12 * np.abs(highest)).all()
        ids, best = np.arange(4000), topk.Best(np.full(len(queries), np.iinfo(np.int64).min), 5)
        tree.search(queries, np.full(len(queries), -1), rows, ids, best)
        best.merge()
        assert np.array_equal(best.score.reshape(-1, 5), np.sort(queries @ rows.T, axis=1)[:, ::-1][:, :5])


def test_clustered_vectors_are_pruned():
    """Over half of the pairs of clustered vectors are never scored."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(50, 16))
    clustered = np.floor(64 * (centres[draw.integers(0, 50, 8000)] + 0.05 * draw.normal(size=(8000, 16)))).astype(np.int64)
    ids, queries = np.arange(8000), clustered[::20]
    best = topk.Best(np.full(len(queries), np.iinfo(np.int64).min), 20)
    assert topk.BallTree(clustered, 64).search(queries, ids[::20], clustered, ids, best) < 0.5 * len(queries) * 8000

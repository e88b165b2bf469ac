import math

import numpy as np

from corpusloom.llm import topk


def brute(rows, k, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.query(spark, "/root/testdata/sf0.01").collect())) == brute(rows, 10)


def test_ties_negatives_shards_and_edges(spark):
    rows = [(i, [0.5, -0.25, (i % 3) / 7, -1.0]) for i in range(400)]
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.3]), (1002, [float("nan"), 0.0, 0.0, 0.0]), (1003, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1100, [-9.0, 9.0, -9.0, 9.0]), (1105, [])]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(vectors.filter("vec_id % 100 = 0"), vectors, k=7, lists=3, block=2)
    as_floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(as_floats, 7)
    none = topk.search(vectors.limit(0), vectors.limit(0))
    assert none.count() == 0
    two = vectors.filter("vec_id in (0, 100)")
    assert topk.search(two, two).count() == 2


def test_fewer_than_all_are_resolved():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-900, 900, (20, 64)).astype(float), rng.integers(-900, 900, (3000, 64)).astype(float)
    banned = np.zeros((20, 3000), bool)
    parts = list(topk._lists(q, c, 4))
    whole = q @ c.T
    rows, columns = topk.reported(parts, 10, None, banned)
    assert len(rows) <= 20 * 11 * 4
    kth = np.array([np.sort(whole[i][columns[rows == i]])[-10] for i in range(20)])
    again, places = topk.reported(parts, 10, kth, banned)
    assert len(again) < 0.7 * whole.size
    for i in range(20):
        assert set(np.argsort(-whole[i])[:10]) <= set(places[again == i])


def test_repeated_queries_large_scores_and_further_columns(spark):
    rows = [(0, [float(i), 1.0], 1, "a") for i in (3, 3, 2)] + [(i, [i / 8, 1.0], 2, "b") for i in range(1, 30)] + [(7, [7 / 8, 1.0], 2, "b")]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string"))
    got = sorted(map(tuple, topk.search(vectors.filter("vec_id = 0"), vectors, k=25).collect()))
    assert [r[1] for r in got] == list(range(1, 26)) and [r[2] for r in got].count(7) == 2
    assert got[0] == (0, 1, 29, 2048 * 29 * 128 + 1024 * 1024)
    big = topk.quantise(spark.createDataFrame([(i, [2.0**45 * (i - 2), 2.0**45]) for i in range(6)], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.search(big.filter("vec_id = 5"), big, k=4).orderBy("rank").collect()]
    assert [(r[2], r[3]) for r in got] == [(2, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1), (0, -(2**63))]

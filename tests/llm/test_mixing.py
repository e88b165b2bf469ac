import duckdb
import numpy as np
import pytest

from corpusloom.llm import mixing


def water_fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_takes_match_a_plain_computation(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01").collect()
    want = duckdb.sql(r"select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    size, source = {r[0]: r[2] for r in want}, {r[0]: r[1] for r in want}
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] = sizes.get(source[r["doc_id"]], 0) + r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    target = water_fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 200
    again = mixing.query(spark, "/root/testdata/sf0.01").collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_pairing_keeps_words_and_expectations():
    up = 0
    for seed in range(4000):
        a, b = mixing._pair([1, 30, 0.4], [2, 70, 0.7], seed)
        assert a[2] in (0.0, 1.0)
        assert a[1] * a[2] + b[1] * b[2] == pytest.approx(0.4 * 30 + 0.7 * 70)
        up += (a if a[0] == 1 else b)[2]
    assert up / 4000 == pytest.approx(0.4, abs=0.03)


def test_a_leaf_is_rounded_in_pairs_against_each_other():
    """Neighbours repel each other, no two documents are drawn together, and what stays fractional is small."""
    sizes = sorted((np.random.default_rng(1).lognormal(5, 1, 200).astype(int) + 1).tolist(), reverse=True)
    x, n = 0.35, 1500
    taken, left = np.zeros((n, len(sizes))), []
    for seed in range(n):
        docs = [[i, s, x] for i, s in enumerate(sizes)]
        mixing._first_leaf(docs, x, seed)
        assert sum(s * d for _, s, d in docs) == pytest.approx(x * sum(sizes))
        open_ = [d for d in docs if 0 < d[2] < 1]
        assert len(open_) <= 1
        left += [d[1] for d in open_]
        for i, _, d in docs:
            taken[seed, i] = d
    assert np.abs(taken.mean(axis=0) - x).max() < 0.06
    together = taken.T @ taken / n - np.outer(taken.mean(axis=0), taken.mean(axis=0))
    assert (together - np.diag(np.diag(together))).max() < 0.05  # chance alone gives 0.025
    assert np.mean([together[i, i + 1] for i in range(199)]) < -0.01
    assert np.mean(left) < np.median(sizes)


def test_rows_without_an_id_are_rounded_one_by_one(spark):
    rows = [(None, "a", f"text {k} " * 10) for k in range(400)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.5).collect()
    assert sum(r["copies"] * r["size"] for r in plan) == pytest.approx(0.5 * sum(r["size"] for r in plan), rel=0.01)


def test_many_leaves_leave_one_document_a_source(spark):
    units = spark.range(3000).selectExpr("id as unit", "id % 3 as source_id", "1 + id % 17 as size", "0.3D as x")
    out = {r["unit"]: r["up"] for r in mixing.round_fractions(units, leaf=8).collect()}
    assert len(out) == 3000 and set(out.values()) <= {0, 1}
    for s in range(3):
        whole = sum(1 + u % 17 for u in range(s, 3000, 3))
        assert abs(sum((1 + u % 17) * out[u] for u in range(s, 3000, 3)) - 0.3 * whole) <= 17


def test_edges(edge, clash, empty):
    plan = mixing.plan_mix(edge).collect()
    assert len(plan) == edge.count()
    assert {r["size"] for r in plan if r["doc_id"] in (1, 2, 3)} == {0}
    same = {r["copies"] for r in plan if r["doc_id"] == 6}
    assert len(same) == 1
    mixed = mixing.mix(clash)
    assert mixed.columns[: len(clash.columns)] == clash.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0

import random
import zlib

import duckdb
import numpy as np

from corpusloom.llm import quality
from corpusloom.llm.common import read_table


def test_held_out_accuracy(spark):
    rows = quality.query(spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_terms_equal_a_plain_computation():
    texts = [b"", b"Same words, same Words!! a a a", b"  \n ", "ü-ö 12 ü".encode(), b"same"]
    owner, term, n = quality.bags(texts)
    with np.errstate(over="ignore"):
        one = lambda t: int(quality.bags([t])[1][0])
    got = {(int(o), int(t)): int(c) for o, t, c in zip(owner, term, n)}
    assert sum(c for (o, _), c in got.items() if o == 1) == 9 + 8  # "a a a" is a, again, again
    assert got[1, one(b"same")] == 2 and got[1, one(b"!!")] == 1 and got[1, one(b"a")] == 1 and got[4, one(b"SAME")] == 1
    assert not {o for o, _ in got} & {0, 2}
    assert sum(c for (o, _), c in got.items() if o == 3) == 5 + 4


def test_votes_equal_a_plain_computation():
    rng = np.random.default_rng(0)
    vectors, labels = rng.normal(size=(40, 8)).astype(np.float32), (rng.random(40) < 0.5).astype(np.float32)
    model = quality.Model(np.ones(quality.TERMS), np.zeros((quality.TERMS, 8)), vectors, labels)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    got = model.vote(x, neighbours=5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(60):
        cosines = unit(vectors) @ unit(x[i : i + 1])[0]
        near = np.argsort(-cosines)[:5]
        w = np.maximum(cosines[near], 0)
        assert abs(got[i] - (w * labels[near]).sum() / w.sum()) < 1e-4


def test_vocabulary_alone_decides(spark):
    rnd = random.Random(4)
    pools = [[f"{c}{k}" for k in range(40)] for c in ("alpha", "omega")]  # texts of one shape, words of two kinds
    rows = [(d, " ".join(rnd.choices(pools[d % 2], k=30)) + ".") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(300)], "doc_id long, quality int")
    got = quality.classify(docs, quality.fit(docs, labels)).filter("doc_id >= 300").collect()
    assert len(got) == 100 and all((r["score"] >= 0.5) == r["doc_id"] % 2 for r in got)


def test_labels_that_disagree_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    used = lambda d: zlib.crc32(str(d).encode()) % 3 != 1
    got = {tuple(r) for r in quality.labelled_sample(docs, labels).collect()}
    assert got == {x for d, x in ((1, ("a", 1)), (3, ("", 0))) if used(d)}


def test_edges(spark, edge, clash, empty):
    labels = read_table(spark, "/root/testdata/sf0.001", "labels")
    few = spark.createDataFrame([(2, 1), (4, 1), (5, 0), (8, None), (None, 1), (99, 1)], "doc_id long, quality int")
    out = quality.classify(clash, quality.fit(edge, few)).collect()
    assert len(out) == edge.count() and all(0 <= r["score_"] <= 1 for r in out)
    again = {r["score_"] for r in out if r["doc_id"] in (5, 6)}
    assert len(again) == 1
    none = quality.fit(edge, labels.limit(0))
    assert {r["score"] for r in quality.classify(edge, none).collect()} == {0.5}
    assert quality.classify(empty, quality.fit(empty, few)).count() == 0
    assert quality.keep_good(edge, few).columns == edge.columns

import hashlib
import random
import zlib

import numpy as np

from corpusloom.llm import periodic


def plain_runs(words):
    """Every lag at every place, and the smallest period by trying all."""
    n, found = len(words), {}
    ids = np.unique(np.array(words), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], ids[: n - q] == ids[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b - a + q), q)  # the smallest lag that shows this stretch
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def random_words(rnd):
    out = []
    for _ in range(rnd.randint(0, 6)):
        unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
        many = unit * rnd.randint(1, 12)
        out += many[: rnd.randint(1, len(many))] + [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))]
    return [w.encode() for w in out]


def test_combs_miss_nothing():
    rnd = random.Random(1)
    for _ in range(1500):
        words = random_words(rnd)
        assert periodic.find_runs(periodic.word_ids(words)) == plain_runs(words), words
    for n in (20, 300, 2500):
        for p in (1, 2, 7, n // 4):
            words = [str(k % p).encode() for k in range(n)]
            words[n // 3] = b"other"
            assert periodic.find_runs(periodic.word_ids(words)) == plain_runs(words)


def test_long_texts_and_ranges_of_lags():
    rnd = random.Random(2)
    pieces = []
    while sum(map(len, pieces)) < 30_000:
        p = rnd.randint(1, 1500)
        unit = [b"%d" % rnd.randint(0, 40) for _ in range(p)]
        pieces.append((unit * 9)[: rnd.randint(3 * p, 9 * p)])
    words = sum(pieces, [])
    ids = periodic.word_ids(words)
    want = plain_runs(words)
    assert len(want) > 5 and periodic.find_runs(ids) == want
    ranges = periodic.lag_ranges(len(ids))
    assert 1 < len(ranges) <= periodic.MAX_RANGES and ranges[0][0] == 1 and ranges[-1][1] == len(ids) // 4 + 1
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert set().union(*(periodic.runs_at(ids, *r) for r in ranges)) == set(want)
    assert set(periodic.runs_at(np.zeros(100_000, np.int32), 12_000, 25_001)) == {(0, 100_000, 1)}


def test_dealt_out_equals_in_place(spark, edge, clash, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = []
    for d, text in rows:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((d, runs, b" ".join(w for i, w in enumerate(words) if i not in drop).decode()))
    for most in (periodic.COMPARISONS, 40):
        for df in (edge, clash):
            got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse(df, most=most).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
        assert periodic.collapse(empty, most=most).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, periodic.query(spark, sf_dir).collect()))
    assert got == sorted(plain_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10

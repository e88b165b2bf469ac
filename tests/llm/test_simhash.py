import random

import xxhash

from corpusloom.llm import graph, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: plain_print(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (docs[a] ^ docs[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in docs.items()}


def test_links_within_two_bits_and_no_further(spark):
    rnd = random.Random(2)
    prints = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        prints += [x, x ^ 1 << rnd.randrange(64), x ^ 1 << rnd.randrange(32) ^ 1 << rnd.randrange(32, 64), x ^ 7 << rnd.randrange(60)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes)).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    seen = {}
    for p in prints:
        if p not in seen:
            stack = [p]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen[x] = p
                    stack += [y for y in prints if near(x, y)]
    assert {p: got.get(p, p) for p in prints} == seen


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300))


def test_documents_with_one_to_five_changed_words_are_near_duplicates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    rows, near, far = [], [], []
    for d in range(600):
        words = [word() for _ in range(rnd.randint(60, 400))]
        copy = list(words)
        for at in rnd.sample(range(len(words)), 1 + d % 5):
            copy[at] = word()
        a, b = shingles(words), shingles(copy)
        (near if len(a & b) >= 0.8 * len(a | b) else far).append(1000 + d)
        rows += [(d, " ".join(words)), (1000 + d, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print(f"recall {1 - len(kept & set(near)) / len(near)} of {len(near)}, {len(far)} farther")
    assert len(near) > 400 and len(far) > 20
    assert len(kept & set(near)) <= 0.005 * len(near)
    assert kept >= {*range(600), *far}


def test_edges(edge, clash, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5
    kept = simhash.keep_first(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 7, 8]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_rows_of_one_id_with_other_texts_all_stay(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "y"), (2, a + " more", "z"), (3, c, "w"), (None, c, "v")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect())
    assert got == sorted([("1", a), ("1", b), ("3", c), ("None", c)])


def test_near_fingerprints_are_near_duplicates(spark):
    """The pipeline's stage links what op9 links, also where few of the distinct shingles are equal."""
    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows = []
    for d in range(0, 40, 2):
        song = " ".join([text(11)] * 41)
        rows += [(d, song), (d + 1, song + " " + text(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_prints(docs).collect()}
    assert len(set(want.values())) < 30
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == set(want.values())

import hashlib
import random
import re

import duckdb

from corpusloom.llm import fim


def plain(doc_id, text, fim_percent=100, spm_percent=50):
    """The contract, written out."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_summaries_are_the_automaton_s_and_compose():
    rnd = random.Random(1)
    for _ in range(3000):
        piece = bytes(rnd.choice(b"<<PSM>>\n\na") for _ in range(rnd.randint(0, 7)))
        nexts, begun = fim.summary(piece)
        for s in range(fim.STATES):
            state, count = s, 0
            for byte in piece:
                state, new = fim.step(state, byte)
                count += new
            assert (nexts[s], begun[s]) == (state, count), (piece, s)


def test_pieces_of_any_size_give_the_contract(spark):
    """Small pieces cut everywhere: in markers, in characters, before and after line ends."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["<", "P", "S>", "M>", "\n", "a", "ü", "日本", "\n\n", " b"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["x\n" * 300, "no end " * 200, "\n" * 400, "one line\n", None, ""]
    docs = [(k % 150, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted((plain(*d) for d in docs), key=str)
    assert len({w[2] for w in want}) == 3
    for piece, fan in ((3, 200), (7, 16), (64, 5)):
        assert rows_of(fim.transform(df, piece=piece, fan=fan)) == want


def test_percentages(spark):
    docs = [(d, "a\nb\nc\nd\n") for d in range(300)]
    got = rows_of(fim.transform(spark.createDataFrame(docs, "doc_id long, text string"), fim_percent=40, spm_percent=0))
    assert got == sorted((plain(*d, 40, 0) for d in docs), key=str)
    assert {r[2] for r in got} == {"plain", "psm"}


def test_edges_and_long_texts(spark, edge, clash, empty):
    want = sorted((plain(r["doc_id"], r["text"]) for r in edge.collect()), key=str)
    assert rows_of(fim.transform(edge)) == want == rows_of(fim.transform(clash))
    assert fim.transform(empty).count() == 0 and fim.restore(fim.transform(empty)).count() == 0
    big = "".join(f"line {k} ü\n" * (k % 3) + "<P" * (k % 2) for k in range(30_000))
    docs = [(d, big) for d in range(6)] + [(7, big + "<M>"), (8, "y" * 200_000), (8, "y" * 200_000), (9, "\n" * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(fim.transform(df)) == sorted((plain(*d) for d in docs), key=str)
    assert sorted(r["restored"] for r in fim.restore(fim.transform(df)).collect()) == sorted(d[1] for d in docs)


def test_query_equals_sql_and_contract(spark, sf_dir):
    got = fim.query(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cursor = con.execute(fim.SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    rows = rows_of(got.select(*names))
    assert rows == sorted(map(tuple, cursor.fetchall()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(*p[:5], sha(p[5]), sha(d["text"] or "")) for d in docs for p in [plain(d["doc_id"], d["text"])]]
    assert rows == sorted(want, key=str)

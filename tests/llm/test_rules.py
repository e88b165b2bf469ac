import duckdb

from corpusloom.llm import queries, rules


def test_equals_the_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op8_quality_rules"])
    names = [c[0] for c in cursor.description]
    got = rules.query(spark, path).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_repeated_words():
    plain = [b"w%d" % i for i in range(30)]
    assert rules.repeated_words(plain) == 0
    assert rules.repeated_words(plain[:8] + [b"x"] + plain[:8]) == 16
    assert rules.repeated_words([b"a"] * 20) == 20
    assert rules.repeated_words(plain[:10] + plain[:9]) == 18


def test_a_line_above_the_limit_goes_and_depleted_documents_are_rejected(spark):
    common = "click here to read more about our cookies and the many partners that we work with every single day of the year"
    own = lambda i: " ".join(f"{chr(97 + (i * 7 + k) % 26)}{i}q{k}".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(40))
    rows = [(i, "host", f"{common}\n{own(i)}") for i in range(50)] + [(100 + i, "host", f"{common.upper()}\nend {'abcdefghij'[i]}") for i in range(5)]
    rows += [(200 + i, "copies", own(999)) for i in range(60)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i]["kept"] and got[i]["kept_words"] == 40 for i in range(50))
    assert not any(got[100 + i]["kept"] or got[100 + i]["base_failed"] for i in range(5))
    assert all(got[200 + i]["kept"] for i in range(60))


def words(*key, n=8):
    return " ".join("w" + "".join(chr(97 + int(d)) for d in str(k)) + chr(97 + j) for k in key for j in range(n))


LINE = "one line of twenty words or more that a part of the documents of a large host have in common with each other"


def planted():
    """A hot host with a line in 5 % of its documents, a header of four lines, a group of near copies, a smaller host."""
    rows = [(i, "hot", f"{LINE}\n{words(i, n=5)}" if i < 50 else f"{words(i)}\n{words(5000 + i)}\n{words(9000 + i)}") for i in range(1000)]
    rows += [(2000 + i, "hot", "\n".join([words(70001), words(70002), words(70003), words(70004), words(20000 + i, n=12), words(30000 + i, n=12)])) for i in range(200)]
    near = [words(80000 + k) for k in range(12)]
    rows += [(4000 + i, "hot", "\n".join(near[: i % 12] + [words(40000 + i)] + near[i % 12 + 1 :])) for i in range(400)]
    rows += [(6000 + i, "hot", rows[600][2]) for i in range(300)]
    return rows + [(7000 + i, "small", f"{LINE}\n{words(50000 + i, n=5)}") for i in range(20)] + [(7100, None, None), (7101, None, "")]


def test_hot_hosts_lose_lines_and_groups_of_copies_stay(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in rules.judge(docs).filter("doc_id < 7100").collect()}
    assert {i for i, r in got.items() if not r["kept"]} == set(range(50))
    assert all(got[2000 + i]["kept_words"] < got[2000 + i]["n_words"] for i in range(200))  # headers go
    assert all(r["kept_words"] == r["n_words"] for i, r in got.items() if 50 <= i < 2000 or i >= 6000)
    assert all(r["n_words"] - r["kept_words"] <= 8 for i, r in got.items() if 4000 <= i < 6000)  # near copies: a line at most


def test_planted_lines_equal_the_sql(spark, tmp_path):
    docs = spark.createDataFrame(planted(), "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op8_quality_rules"])
    got = rules.query(spark, str(tmp_path)).select(*[c[0] for c in cursor.description]).collect()
    assert sum(not r["kept"] and not r["base_failed"] for r in got) == 50
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_edges(edge, clash, empty):
    rows = rules.judge(clash).collect()
    assert len(rows) == edge.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert next(r["n_words"] for r in rows if r["doc_id"] == 7) == 30_001
    assert rules.judge(empty).count() == 0

"""Every query with an oracle gives DuckDB's rows; the others run and keep their invariants."""

import duckdb
import pytest

from corpusloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return found


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_the_oracle(spark, sf_dir, con, name):
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    frame = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(frame.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert order(plain(r) for r in frame.select(*columns).collect()) == order(plain(r) for r in cursor.fetchall())


def test_plans_keep_budgets_and_quote_the_text(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpusloom.operators import lines

    texts = {r["doc_id"]: r["normalized"] for r in lines.normalize(catalogue._contracts(spark, sf_dir).filter("doc_id < 20")).collect()}
    rows = catalogue.QUERIES["c05_plan"](spark, sf_dir).filter(F.col("doc_id") < 20).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert len(r["text"]) <= 900
        for part in r["text"].split("\n\n"):
            body = part.split("]\n", 1)[1] if part.startswith("[Excerpt") else part
            assert body in texts[r["doc_id"]]
        assert r["strategy"] != "relevance" or r["included_hits"] == r["hit_blocks"]

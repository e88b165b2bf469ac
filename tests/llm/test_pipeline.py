import corpus_pipeline
from corpusloom.llm import passages, quality, simhash
from corpusloom.llm.common import read_table


def test_stages_follow_each_other(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= set(seen)
        if name == "quality_classifier":
            good = quality.classify(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"))).filter("score >= 0.5")
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in good.collect()}
        if name == "simhash_near_dedup":
            found = simhash.near_duplicates(docs).collect()
            assert sorted(r["doc_id"] for r in rows) == sorted({r["component_id"] for r in found})
        if name == "substring_dedup":
            assert passages.repeats(out).count() == 0
        docs = spark.createDataFrame(rows, out.schema)
        seen = {r["doc_id"]: r["text"] for r in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(last)


def test_empty(spark, sf_dir, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0

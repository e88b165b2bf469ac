import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.ByteBpe(PATH, cache=50)
ODD = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'ll", "1", "²", "!!", "<|endoftext|>", "\xa0", "\x85", "　", "\x1c", "日本", "\U0001f600", "x" * 60])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), ODD))
def test_ids_equal_the_librarys(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text).tolist() == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_query_digests(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = THEIRS.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_edges(clash, edge, empty):
    rows = bpe.decode(bpe.encode(clash), ids_col="ids_").collect()
    assert [r["decoded_"] for r in rows] == [r["text"] or "" for r in edge.collect()]
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert bpe.merge_symbols([], {}, []) == []


def test_a_worker_remembers_no_more_words_than_the_cache_has_room_for():
    cache = bpe._Cache(str.encode, 100)
    for i in range(1000):
        assert cache.get(f"w{i}") == f"w{i}".encode()
        assert len(cache._young) + len(cache._old) <= 100
    assert cache.all(["w999", "w1", "w990"]) == [b"w999", b"w1", b"w990"]

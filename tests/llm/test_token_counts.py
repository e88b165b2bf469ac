import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import token_counts

THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_counts(text, sections):
    """Tokens by section from the library's own offsets (ASCII texts): the largest overlap owns a token."""
    out = [0] * len(sections)
    for a, b in THEIRS.encode(text, add_special_tokens=False).offsets:
        over = [min(b, hi) - max(a, lo) for _, lo, hi in sections]
        out[over.index(max(over))] += 1
    return out


def test_counts_equal_the_librarys_offsets(spark):
    texts = ["Head line\n| a | b |\n\nSome prose, it's fine.\n  indented", "one", "a\n\n\n\nb", "x" * 500 + "\n" + "word " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(docs).collect():
        sections = token_counts.line_sections(r["text"])
        assert [(s["name"], s["start"], s["end"]) for s in r["sections"]] == sections
        assert [s["tokens"] for s in r["sections"]] == plain_counts(r["text"], sections)


def test_boundaries_inside_tokens_and_gaps(spark):
    docs = spark.createDataFrame([(1, "international 日本語 words")], "doc_id long, text string")
    cut = lambda text: [("a", 0, 3), ("b", 5, 15), ("c", 15, 99)]
    got = token_counts.count_tokens(docs, sections_of=cut).first()
    assert [(s["name"], s["start"], s["end"]) for s in got["sections"]] == [("a", 0, 3), ("", 3, 5), ("b", 5, 15), ("c", 15, 23)]
    assert sum(s["tokens"] for s in got["sections"]) == got["n_tokens"] and got["n_crossing"] >= 1
    first = token_counts.count_tokens(docs, sections_of=cut, rule="first").first()
    assert first["sections"][0]["tokens"] == 1 and got["sections"][0]["tokens"] == 0


def test_query_adds_up(spark, sf_dir):
    for r in token_counts.query(spark, sf_dir).collect():
        assert r["n_tokens"] == r["head_tokens"] + r["prose_tokens"] + r["table_tokens"] + r["blank_tokens"]


def test_edges(edge, clash, empty):
    rows = token_counts.count_tokens(clash).collect()
    assert len(rows) == edge.count()
    assert all(sum(s["tokens"] for s in r["sections_"]) == r["n_tokens_"] for r in rows)
    assert token_counts.count_tokens(empty).count() == 0

import pytest

EDGE = [
    (1, None, "en", None, 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one", "en", "b", 3),
    (5, "The same few words, twice. " * 12, "en", "b", None),
    (6, "The same few words, twice. " * 12, "en", "c", 5),
    (6, "The same few words, twice. " * 12, "en", "c", 5),
    (None, "a row without an id " * 8, "en", None, 1),
    (None, "another row without an id " * 8, None, None, 1),
    (7, "x" * 30_000 + " " + "long " * 30_000, "en", "b", 9),
    (8, "tail <|endoftext|> tail <|end|> \\l ü 日本 \U0001f600", "fr", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(edge):
    """Further columns under the names that operators add."""
    from pyspark.sql import functions as F

    names = "score ids decoded copy size unit target h t fp uid label chunk sections n_tokens _first cut_id component_id".split()
    return edge.select("*", *(F.lit(1).alias(n) for n in names))

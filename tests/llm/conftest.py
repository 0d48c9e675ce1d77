import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: nulls in every column, empty and wordless texts, repeated rows, repeated ids, a long text
ODD = [
    (1, "The first text has words.\nIt has two lines, and more of them.", "en", "a", 1),
    (1, "The first text has words.\nIt has two lines, and more of them.", "en", "a", 1),
    (1, "the same id with other words", None, "b", None),
    (None, "a text without an id", "en", "a", 2),
    (None, None, None, None, None),
    (3, None, "de", "b", 0),
    (4, "", "de", None, 0),
    (5, " \n\t ", "de", "", 3),
    (6, "12 !! 34", "de", "", 3),
    (7, "x " * 60_000, "en", "a", 120_000),
    (8, "ünïcödé 日本語 текст 😀 <|endoftext|> </s>", "fr", "c", 9),
    (9, "x " * 60_000, "en", "a", 120_000),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def clash(odd):
    """Columns whose names the operators might use inside."""
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(1).alias(c) for c in ("i", "t", "h", "k", "row", "__id", "size", "key", "fp", "node", "a.b", "n", "start")))


@pytest.fixture
def none(odd):
    return odd.limit(0)

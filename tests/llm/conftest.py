import pytest

#: Nulls, empty texts, repeated rows, ties, and columns whose names clash with what operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `offset` string, removed_spans string, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, " \t\n "), (None, "a null id has words of its own here"), (5, "long " * 30_000)]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])

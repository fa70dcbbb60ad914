import pytest

#: Rows of every awkward kind: nulls, empty and long texts, repeated rows, ties.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox jumps over the lazy dog.\nplain tail"),
    (2, None),
    (3, ""),
    (4, " \t\n\v\f\r "),
    (5, "é ü ñ 東京 \U0001f600 á \x1c\x85 x"),
    (6, "word " * 20_000),
    (7, "x" * 100_000),
    (8, "one two three four five six seven eight nine ten eleven twelve " * 3),
    (8, "one two three four five six seven eight nine ten eleven twelve " * 3),
    (9, "one two three four five six seven eight nine ten eleven twelve " * 3),
    (None, "one two three four five six seven eight nine ten eleven twelve " * 3),
]


@pytest.fixture
def awkward(spark):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, None, "x", 1, 2.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, payload string, kept string, block int, score double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

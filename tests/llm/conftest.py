import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, and an extra column with a clashing name."""
    rows = [
        (1, None, "n"), (2, "", "n"), (3, " \n\t ", "n"), (4, "one two", "n"), (5, "one two", "n"), (5, "one two", "n"), (None, "no id here at all a@b.co", "n"),
        (6, "word " * 30_000, "n"), (7, "x" * 90_000, "n"), (8, "9" * 70_000, "n"), (9, "Ünïcödé 😀 \\ </s>[INST] é\x00\x1c.", "n"), (10, "a.b@" * 20_000, "n"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

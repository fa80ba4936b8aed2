import random

import pytest

LONG = "lorem ipsum dolor " * 60_000
AWKWARD = [
    None, "", " ", "\n\t ", "one", "two words", "a b c d", "A B C D", "a  b   c d e", "x" * 5000, "tab\tand\nline\r\nfeeds\n\nhere ",
    "é ü ß ▁mark 😀 中文 字", "nul\0byte and\x1cseparator", " lead and trail ", "password = hunter2", "...", "12345 67890", "one two three four five six seven eight nine ten " * 30,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, odd and long texts, repeated rows and ids, and columns of clashing names."""
    rows = [(i, t, None if i % 3 else "en", None, 0.5, i, "k") for i, t in enumerate(AWKWARD)]
    rows += [(100, LONG, "en", "s", None, 1, None), (101, "same text here again", "en", "s", 1.0, 1, "k"), (101, "same text here again", "en", "s", 1.0, 1, "k"), (101, "another text of that id", "de", "s", 1.0, 1, "k"), (None, "a row without an id", "en", "s", 1.0, 1, "k"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, label long, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def prose(r: random.Random, n: int, words: list[str]) -> str:
    return " ".join(r.choice(words) for _ in range(n))

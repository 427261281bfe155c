import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    part = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower by the sea"
    rows = [
        (1, part, "en", "s0", 10, "x", 0), (2, part, "en", "s0", 10, "y", 1), (2, part, "en", "s0", 10, "y", 1), (3, None, None, None, None, None, None), (4, "", "en", None, 0, "z", 2),
        (5, long, "en", "s1", 5, None, 3), (6, long + " tail", None, "s1", None, "x", 4), (None, part, "en", "s0", 1, "x", 5), (7, "MIT License and Apache License, cc by", "en", "s0", 3, "q", 6),
        (8, "1234 %% --", None, "s2", 4, "q", 7), (9, "un deux trois " + part + " é€😀 fin", "fr", "s2", 4, "q", 8), (10, " \n\t ", "fr", "s2", 4, "q", 9), (11, "a b", "en", "s", 3, "", 1), (12, "a  b", "en", "s", 3, "", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("doc_id = -1")

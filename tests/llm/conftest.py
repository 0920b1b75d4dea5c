import pytest
from llm_cases import ODD_SCHEMA


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns named like results."""
    words = [f"word{n % 97}x{n % 89}" for n in range(60_000)]
    plain = " ".join(words[:40])
    rows = [
        (1, plain, "en", "a", 1, "r", 0.5, "k", 1),
        (1, plain, "en", "a", 1, "r", 0.5, "k", 1),
        (2, plain, "en", "b", 1, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (None, "some words of no id at all", "en", "a", 1, "r", 0.5, "k", 1),
        (None, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "r", 0.5, "k", 1),
        (5, " \n\t ", "en", "b", 0, "r", 0.5, "k", 1),
        (6, " ".join(words), "en", "a", 1, "r", 0.5, "k", 1),
        (7, "!!! ### ...", "de", "c", 1, "r", 0.5, "k", 1),
        (8, "short one", "de", "c", 1, "r", 0.5, "k", 1),
        (9, "short one", "de", "c", 1, "r", 0.5, "k", 1),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)

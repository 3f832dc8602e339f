import random

import pytest

from attestra.llm.common import Workspace

SCHEMA = "doc_id long, text string, node string, __att_maybe string, key long, run int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture
def ws(spark):
    out = Workspace(spark, "test")
    yield out
    out.delete()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like internal ones."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 120)
    rows = [
        (1, "Hello World", "x", None, 7, 1), (2, "hello world", None, "y", None, None), (3, "HELLO WORLD", "x", "y", 7, 1), (3, "HELLO WORLD", "x", "y", 7, 1),
        (4, None, None, None, None, None), (5, "", "x", "y", 7, 1), (None, "no id", "x", "y", 7, 1), (None, None, None, None, None, None),
        (6, long, "x", "y", 7, 1), (7, long, "x", "y", 7, 1), (8, "Ünïcode ÀÉ\tline\n\nß", "x", "y", 7, 1), (9, "ünïcode ÀÉ\tline\n\nß", "x", "y", 7, 1),
        (10, base, "x", "y", 7, 1), (11, base + " tail", "x", "y", 7, 1), (12, words(rng, 80), "x", "y", 7, 1), (12, words(rng, 90), "x", "y", 7, 1),
    ]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)

"""Small awkward tables for the operators."""

import random

import pytest

WORDS = "the and of river stone light paper cloud green quick seven table north music garden silver".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", str(r.randrange(9))]) for _ in range(n))


AWKWARD = [
    (1, prose(1, 80), "a"), (2, prose(1, 80), "a"), (3, prose(1, 80) + " more", "b"), (4, None, "a"), (5, "", None),
    (6, " \n\t ", "b"), (7, prose(2, 30) + "\n" + prose(3, 40), None), (8, "one two", "c"), (9, "x" * 3000, "c"),
    (10, prose(4, 3000), "b"), (11, prose(5, 60), "a"), (11, prose(5, 60), "a"), (None, prose(6, 50), "a"),
    (None, prose(6, 50), "a"), (12, "a b c d e f g h " * 30, "d"), (13, "Ünïcödé 𝄞 text here " * 12, "d"),
    (14, "same line here\n" * 9 + prose(7, 30), "c"), (15, "password: hunter2xyz and AKIA" + "A1B2" * 5, "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeats, and extra columns with clashing names."""
    rows = [(*r, "x", 1, True) for r in AWKWARD]
    schema = "doc_id long, text string, source string, spans string, size long, kept boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

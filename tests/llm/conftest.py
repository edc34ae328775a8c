import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, tokens string, kept string, row string"
WORDS = (
    "the of and station harbour winter copper letter morning engine river signal garden paper window market bridge valley number doctor silver "
    "summer mountain question answer island village captain thunder yellow corner history music kitchen travel picture animal forest planet "
    "weather reason minute country teacher family machine water glass table street northern careful heavy simple early second empty narrow"
).split()


def prose(rng: random.Random, n: int) -> str:
    starts, ends = ["", "", "", "over", "under", "out", "counter", "inter"], ["", "", "s", "ed", "ing"]
    return " ".join(rng.choice(starts) + rng.choice(WORDS) + rng.choice(ends) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(7)
    base = prose(rng, 300)
    rows = [(i, prose(rng, 120 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s0"), (101, base, "en", "s0"), (102, base + " tail", "de", None)]
    rows += [(110, "", "en", "s1"), (111, None, None, None), (None, base, None, "s1"), (None, None, None, None), (112, " \t\n ", "fr", "s2")]
    rows += [(113, prose(rng, 60_000), "es", "s0"), (114, "word", "xx", "s0"), (115, "ünïcödé 漢字 " * 40, "zz", "s1")]
    return [(i, t, g, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, g, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

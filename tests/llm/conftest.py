import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, __hot boolean, kept string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source), with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), True, "x") for r in rows]
        return spark.createDataFrame(full, DDL)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, single words, non-ASCII, very long, and repeats."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "délta", "the", "of", "x1", "ω", "end."]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [None, "", "   \n\t", "one", "two words", "\U0001f600 ok", "line\n\nline\n", long, long + " tail", "a" * 200_000, "same text here now", "same text here now"]

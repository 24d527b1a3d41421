import random

import pytest

from changerisk.llm.shared import ship_code

#: Columns named like working columns of the operators.
CLASHES = ["size", "score", "row", "same", "copies", "lang_pred", "log_ratio", "hit_words", "group", "place", "id", "bands"]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_code(spark)


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text, lang, source) rows, with columns that may clash."""

    def make(rows, clash=True):
        extra = CLASHES if clash else []
        ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], ddl)

    return make


@pytest.fixture
def edge_rows():
    """Nulls in every column, empty and blank texts, no letters, a very long text, repeated rows, ties."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice(["ba", "ko", "the", "ir", "é"]) for _ in range(3)) for _ in range(60_000))
    return [
        (None, None, None, None),
        (None, "no id here, but words", "en", "a"),
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", "de", None),
        (4, "!!! 123 ***", "de", "b"),
        (5, "Word", "en", "b"),
        (6, long, "en", "a"),
        (7, "the same words stand here twice over and over", "en", "a"),
        (7, "the same words stand here twice over and over", "en", "a"),
        (8, "the same words stand here twice over and over", None, "c"),
        (9, "Straße ÉCOLE naïve 中文 x\u0000y", "de", "c"),
    ]


@pytest.fixture
def prose():
    """Invented texts of a few languages' syllables, the same in every run."""

    def make(n, seed=1, sizes=(5, 120), syllables=("tha", "er", "on", "ing", "ble", "re", "st")):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
        return [" ".join(word() for _ in range(rng.randint(*sizes))) for _ in range(n)]

    return make

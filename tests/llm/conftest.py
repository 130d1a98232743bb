import random

import pytest

SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "sha", "vel", "dor", "pi", "na"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


# Columns that operators use inside or add.
CLASHES = ("row", "_row", "key", "size", "sources", "copies", "taken_by", "fp", "group", "score", "n_lines", "n_dropped", "drop", "doc", "cut", "label", "id", "v", "node")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = prose(1, 60_000) + " " + "x" * 3_000
    rows = [
        (1, "Same text here.\nA second line", "en", "a"),
        (1, "Same text here.\nA second line", "en", "a"),
        (2, "same TEXT here.\na SECOND line ", "en", None),
        (3, None, None, None),
        (None, "no id at all", "en", "b"),
        (None, None, None, None),
        (4, "", "en", "b"),
        (5, " \t\n\n ", "en", ""),
        (6, long, "en", "a"),
        (7, "é ü 日本語 İstanbul 'll x'RE", "fr", "c"),
        (8, prose(2, 40), "en", "a"),
        (9, prose(2, 40) + " ka", "en", "a"),
        (8, prose(3, 30), "en", "b"),
    ]
    rows = [(*r, len(r[1]) if r[1] is not None else None, *(f"{c}!" for c in CLASHES)) for r in rows]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

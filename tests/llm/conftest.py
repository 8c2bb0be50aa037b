"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def words(random_: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{random_.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with every awkward case."""
    r = random.Random(4)
    base = words(r, 120)
    rows = [(0, None, "en", None, None), (1, "", None, "a", 0), (2, " \t\n\x0b\x0c\r ", "en", "a", 7),
            (3, base, "en", "b", 1), (4, base, "en", "b", 1), (4, base, "en", "b", 1),
            (5, base.replace(" ", "  "), "en", "b", 1), (6, base.upper(), "en", "c", 1),
            (7, base + " tail", "en", None, 1), (None, base + " tail", "en", "c", 1),
            (None, None, None, None, None), (8, "one two", "en", "c", 1),
            (9, "One  two", "en", "c", 1), (10, words(r, 20_000), "en", "b", 1),
            (11, "x" * 60_000, "en", "b", 1), (12, "é \u3000 ü" * 50, "en", "ä", 1),
            (13, "a " * 3_000, "en", "", 1), (14, base[:300] + words(r, 40), "en", "b", 1)]
    for i in range(20, 80):
        text = words(r, r.choice((1, 3, 30, 60, 200)))
        rows.append((i, text, "en", r.choice("abc"), 1))
        if i % 3 == 0:
            changed = text.split()
            changed[r.randrange(len(changed))] = "changed"
            rows.append((i + 100, " ".join(changed), "en", r.choice("abc"), 1))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ROWS).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ROWS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, n int, id string, label int, `group` string, best string, h1 string"


def words(seed: int, n: int, syllables: str = "ka lo mi ru te sa no vi") -> str:
    rng = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with columns whose names clash with those that operators use."""

    def build(rows, parts: int = 3):
        full = [(i, t, "en", "s", len(t) if t is not None else None, 7, 0.5, 1, "x", 2, "g", "b", "h") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and long texts, ties and rows that occur twice."""
    long = words(1, 30_000)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "Kalo miru tesa."), (4, "Kalo miru tesa."), (5, "Kalo miru tesa."), (None, "novi"), (None, None), (6, long), (7, long), (8, "😀 ünï ß\n\n" + words(2, 40)), (9, words(2, 40))]

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        return spark.createDataFrame(full, DOCS).withColumn("n_chars", F.length("text").cast("long"))

    return build


def words(seed: int, n: int) -> list[str]:
    """Prose-like words, the same for a seed."""
    import random

    rng = random.Random(seed)
    parts = ["an", "the", "re", "ti", "on", "sh", "er", "ed", "ing", "ou", "at", "is"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


#: Rows that every operator has to take.
ODD = [
    (None, "a text without an id"),
    (None, None),
    (7, None),
    (8, ""),
    (9, " \t\n "),
    (10, "one"),
    (11, prose(3, 9000)),
    (12, "same row twice with some words in it"),
    (12, "same row twice with some words in it"),
    (13, "Ünï   日本語 \U0001f600 é <|endoftext|>"),
]

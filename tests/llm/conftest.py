from __future__ import annotations

import random

import pytest

CLASHES = "text string, n long, n_chars long, class string, token string, score double, key string, size long, copies long, rank int"


def make_text(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(["the", "of", "And", "straße", "niño", "tion,", "er", "an", "\n", "wh"]) + str(rng.randint(0, 9)) for _ in range(words))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows and clashing columns."""
    rng = random.Random(5)
    base = make_text(rng, 120)
    near = base.replace("the", "THE", 3) + " tail"
    rows = [(1, base, "b"), (2, base.upper(), "b"), (3, near, None), (4, None, "a"), (5, "", "a"), (6, " \t\n ", None), (7, "one two", "c"),
            (8, "One  two\n", "c"), (9, make_text(rng, 30_000), "a"), (10, base, "b"), (10, base, "b"), (None, base, "z"), (12, "a b c d e f", ""),
            (13, make_text(rng, 200), "é")]
    rows += [(20 + i, make_text(rng, rng.randint(1, 80)), rng.choice("abc")) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F
    for name in ("n", "class", "token", "score", "key", "size", "copies", "rank", "bucket", "spans", "label", "same", "at"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

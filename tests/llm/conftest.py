import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]) rows, with columns whose names clash with those inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "fp", "key", "gram", "length", "score", "n_words", "_row", "k1", "bits", "copies"):
            docs = docs.withColumn(name, F.lit("x"))
        return docs

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties and rows that repeat."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta.", "épée", "naïve", "#tag", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(60_000)
    twin = text(90)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"), (6, twin), (7, twin),
        (None, twin), (None, None), (8, long), (9, text(300)), (9, text(40)), (10, "line\nline\n\nline " + text(30)),
        (11, twin + " tail"), (12, "\x0b" + twin.upper() + "\r\n"), (13, "word " * 500),
    ]


@pytest.fixture(scope="session")
def given(spark, small):
    """(doc_id, text) of the smallest tables."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]

import random

import pytest


@pytest.fixture(scope="session")
def doc():
    """Makes document tables: rows of (doc_id, text, lang, source)."""

    def make(spark, rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if extra:  # names an operator might use itself
            from pyspark.sql import functions as F

            for c in ("row", "key", "n", "mix_size", "shard_key", "quality_score", "size", "a", "id"):
                df = df.withColumn(c, F.lit(f"mine-{c}"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented words and texts, alike in every run."""
    rng = random.Random(7)
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "st", "in", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def text(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return text

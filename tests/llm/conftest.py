import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, kind string, matched string, word string, node int"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, source, len(t or ""), 7, "k", "m", "w", 9) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = "the of and thon erin tion attion ther chip loser".split()
    long = " ".join(rng.choices(words, k=30_000))
    base = [(1, None, "en", "src0"), (2, "", "en", None), (3, "   \n\t ", None, "src1"), (None, "a text without an id", "en", "src0"), (4, long, "en", "src2"), (5, "x" * 5000, "en", "src1"), (6, "été à la forêt 漢字 <|endoftext|>", "fr", "src1"), (6, "été à la forêt 漢字 <|endoftext|>", "fr", "src1"), (7, "1234 5678", "en", "src0")]
    return base + [(100 + i, " ".join(rng.choices(words, k=40)), "en", f"src{i % 3}") for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []) if False else spark.createDataFrame([], SCHEMA)

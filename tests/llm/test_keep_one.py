"""One row of each near-duplicate component, where ids are missing or repeated."""

import random

from newslake.llm import simhash


def test_rows_without_their_own_id(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, e), (9, e), (None, e), (9, f), (None, f), (3, f"{a} "), (4, None), (None, "")]
    table = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, row int")
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, f"{a} "), (None, b), (7, c), (7, d), (8, e), (9, f), (4, None)], key=str)

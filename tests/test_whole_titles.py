"""F8 over whole titles against edit distances by the textbook."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from newslake.functions import text as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_titles_beyond_60_characters(spark, tmp_path):
    head = "é" * 30 + "x" * 31
    titles = [head + " one end", head + " quite another", "été 漢字", "ete", "é"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(titles)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: round(1 - edits(a, b) / max(len(a), len(b)), 6) for i, (a, b) in enumerate(zip(titles, titles[1:]))}
    assert {r.doc_id: r.ratio for r in queries()["f8_edit_ratio_whole"](spark, str(tmp_path)).collect()} == want
    score = {r.doc_id: r.score for r in queries()["f8_fuzzy_score"](spark, str(tmp_path)).collect()}
    assert want[0] <= score[0] < 1


def test_partial_ratio(spark):
    pairs = [("abc", "xxabcxx"), ("abd", "xxabcxx"), ("", ""), ("", "a"), ("same", "same"), ("été", "un été chaud"), ("a longer one", "long")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r.p for r in rows.select(T.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()]

    def want(a, b):
        s, t = sorted((a, b), key=len)
        return (1.0 if not t else 0.0) if not s else max(1 - edits(s, t[i : i + len(s)]) / len(s) for i in range(len(t) - len(s) + 1))

    assert got == [want(a, b) for a, b in pairs]

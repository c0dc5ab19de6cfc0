from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import pii
from newslake.functions import text as T
from newslake.functions import url as U


def values(spark, column, rows, name="x"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in frame.select(column.alias("v"), "i").orderBy("i").collect()]


def test_canonical_url(spark):
    got = values(spark, U.canonical_url(F.col("x")), ["  HTTPS://Ex.com:443/a/?b=2&a=1&utm_source=z&c=#top", "http://ex.com:80/", "ftp://ex.com/", "http:///x", "https://e.com/p/;v=1?q=a+b%2F", None, ""])
    assert got == ["https://ex.com/a?a=1&b=2", "http://ex.com", None, None, "https://e.com/p;v=1?q=a+b%2F", None, None]


def test_titles(spark):
    assert values(spark, T.clean_headline(F.col("x")), ["A &amp;amp; <b>B</b> “c” — d", "ab", None]) == ['A & B "c" - d', None, None]
    assert values(spark, T.sanitized_title(F.col("x")), ["3. Foo", "3D print", "5G is here", "#4 Bar"]) == ["Foo", "3D print", "5G is here", "Bar"]
    assert values(spark, T.clean_headline(F.col("x"), T.unescaped), ["caf&eacute; now"]) == ["café now"]


def test_shingles_and_jaccard(spark):
    assert values(spark, F.array_join(T.shingles(F.col("x")), "|"), ["one", "a b a b", ""]) == ["one", "a|b|a b|b a", ""]
    frame = spark.createDataFrame([("new chip a", "new chip b")], "a string, b string")
    assert frame.select(T.jaccard(T.shingles(F.col("a")), T.shingles(F.col("b")))).first()[0] == pytest.approx(3 / 7)


def test_freshness_bounds(spark):
    rows = spark.createDataFrame([(x,) for x in (None, -10.0, 5.0, 5.1, 4320.0, 4321.0)], "a double")
    assert [r[0] for r in rows.select(D.level(F.col("a"))).collect()] == ["unknown", "breaking", "breaking", "very_fresh", "old", "stale"]
    assert [r[0] for r in rows.select(D.score(F.col("a"))).collect()] == [0.5, 1.0, 1.0, 0.999, 0.0, 0.0]


def test_dates(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    got = values(spark, D.parsed(F.col("x"), now, F.lit("https://a/2024/01/09/x")), ["2 hours ago", "Fri, 05 Jan 2024 10:00:00 +0000", "2024-01-03", "nothing"])
    assert got == [datetime(2024, 2, 1, 10), datetime(2024, 1, 5, 10), datetime(2024, 1, 3), datetime(2024, 1, 9)]


def test_importance(spark):
    assert values(spark, T.importance(F.col("x")), ["A backdoor found", "changelog of a merge", "a walkthrough of an outage", "x"]) == [0.75, 0.3, 0.45, 0.5]


def test_pii(spark):
    got = values(spark, pii.redacted(F.col("x")), ["mail a.b@c.example.com, card 4111 1111 1111 1111, not 4111 1111 1111 1112", "ssn 123-45-6789 ip 10.0.0.1"])
    assert got == ["mail [EMAIL], card [CARD], not 4111 1111 1111 1112", "ssn [SSN] ip [IPV4]"]


def test_null_and_empty_texts(spark):
    for f in (T.words, T.sentences, T.shingles, T.word_runs, T.local_summary, T.plain_title, T.word_count):
        values(spark, f(F.col("x")), [None, "", "é ü"])

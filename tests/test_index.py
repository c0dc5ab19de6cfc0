"""The kept text index against the scan that it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from newslake.operators.segments import Conflict, Segments
from newslake.search import engine as E
from newslake.search.index import BUCKETS, TextIndex, _apart, edits_of, marked

WEIGHTS = {"title": 5.0, "clean_text": 1.0, "summary": 2.0, "tags": 3.0}
SCHEMA = "doc_id bigint, title string, clean_text string, summary string, tags array<string>"
WORDS = "deep learning deeply learner learn été Forêt quantum quark 漢字 x9 a_b the of chip chips".split()
QUERIES = ["deep learn", '"deep learning"', '"deep" chip', '"the of the"', "qu", "é", "漢", "x9 a_b", "nothing", "", '"learn learn"', 'the "chip"', "AND OR"]


def rows(seed, ids):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=rng.randrange(k)))
    return [(i, text(6), text(60), text(12), rng.sample(WORDS, rng.randrange(4))) for i in ids]


def same(index, live, query, k=None):
    got = [tuple(r) for r in index.search(query, k).collect()]
    want = [tuple(r) for r in E.bm25(live, query, WEIGHTS, k=k).collect()]
    assert [g[0] for g in got] == [w[0] for w in want], query
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)
    return got


def test_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), WEIGHTS)
    assert index.search("deep").count() == 0
    first, second = rows(1, range(80)), rows(2, range(60, 120))
    df = lambda r: spark.createDataFrame(r, SCHEMA)
    index.add(df(first))
    for query in QUERIES:
        same(index, df(first), query)
    index.add(df(second))  # ids 60 to 79 take the place of others
    live = {r[0]: r for r in first} | {r[0]: r for r in second}
    for query in QUERIES[:5]:
        same(index, df(list(live.values())), query, 7)
    index.delete(df([live[i] for i in range(0, 120, 7)] + [(999, None, None, None, None)]))
    live = {i: r for i, r in live.items() if i % 7}
    assert index.totals()[0] == len(live)
    found = same(index, df(list(live.values())), "deep learn")
    index.add(df(rows(3, [0, 7])))  # deleted ids come back
    live |= {r[0]: r for r in rows(3, [0, 7])}
    before = same(index, df(list(live.values())), "deep learn")
    assert before != found
    index.merged()
    assert same(index, df(list(live.values())), "deep learn") == before
    assert index.parts.vacuumed(keep=1) and same(index, df(list(live.values())), '"deep learning"')
    some = df([live[i] for i in live if i % 2])
    assert [r.doc_id for r in index.search("deep learn", within=some).collect()] == [i for i, _ in before if i % 2]
    assert {r.term: r.df for r in index.terms("lear").collect()} == {w: n for w in WORDS if w.startswith("lear") and (n := sum(any(w in str(x).lower().split() for x in r[1:4]) or w in r[4] for r in live.values()))}


def test_reads_its_terms_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), {"title": 1.0})
    index.add(spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}word" for j in range(26))) for i in range(52)], "doc_id bigint, title string"))
    scanned = index.postings([("abwo", False)])
    plan = scanned._jdf.queryExecution().toString()
    assert "PushedFilters: [StringStartsWith(term,abwo)" in plan.replace("IsNotNull(term), ", "") and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket").replace("PartitionFilters: [[", "PartitionFilters: [") and BUCKETS > 1
    assert "at:array" not in index.postings([("abword", True)]).select("id", "f0")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_nulls_and_repeats(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), WEIGHTS)
    index.add(spark.createDataFrame([(1, None, None, None, None), (None, "deep", "", "", []), (2, "deep", "deep " * 20_000, None, ["x"]), (3, "a", "deep", "", []), (3, "a", "deep", "", [])], SCHEMA))
    assert index.totals()[0] == 3
    assert {r.doc_id for r in index.search("deep").collect()} == {2, 3}
    index.add(spark.createDataFrame([], SCHEMA))
    index.delete(spark.createDataFrame([], SCHEMA))
    assert index.totals()[0] == 3


def test_two_writers(spark, tmp_path):
    parts = Segments(spark, str(tmp_path / "s"))
    entry = parts.stored(spark.range(3).select(F.col("id")), "rows")
    assert parts.commit(0, [entry]) == 1
    with pytest.raises(Conflict):
        parts.commit(0, [])
    assert parts.state() == (1, [entry]) and parts.read([entry], "rows", "id bigint").count() == 3


def test_fuzzy(spark, tmp_path):
    rng = random.Random(5)
    base = ["thonan", "erin", "été", "forêts", "ab", "漢字語文"]
    words = {w for b in base for w in [b, b[1:], b + "x", b[:2] + b[3:4] + b[2:3] + b[4:], b[::-1], "".join(rng.choice("éabn漢") if rng.random() < 0.3 else c for c in b), b[:1] + "zz" + b[3:]]}
    index = TextIndex(spark, str(tmp_path / "i"), {"title": 1.0})
    index.add(spark.createDataFrame(list(enumerate(sorted(words))), "doc_id bigint, title string"))
    for b in base:
        assert set(index.expanded(b)) == {w for w in words if w and _apart(b, w) <= edits_of(b)}
    found = index.fuzzy("thonan").collect()
    assert {sorted(words)[r.doc_id] for r in found} == set(index.expanded("thonan"))
    shown = spark.createDataFrame([("A Thonan, thonans FORÊTS",)], "t string").select(marked(F.col("t"), ["thonan", "forêts"])).first()[0]
    assert shown == "A <mark>Thonan</mark>, thonans <mark>FORÊTS</mark>"


@pytest.mark.parametrize(("a", "b", "n"), [("ab", "ba", 1), ("abc", "", 3), ("thonan", "thonna", 1), ("kitten", "sitting", 3), ("ca", "abc", 3)])
def test_apart(a, b, n):
    assert _apart(a, b) == n

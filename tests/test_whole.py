"""Queries over every row of their tables: no id is left out."""

import random

import pytest

from __spark_entry__ import queries
from newslake.operators import dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, source, column", [("s1_rss", "feed_id", "pages", "page_id"), ("s5_releases", "repo", "pages", "'repo' || page_id"), ("s12_sitemap", "map_id", "pages", "page_id"), ("j3_hydration", "o_orderkey", "orders", "o_orderkey")])
def test_every_id(spark, name, key, source, column):
    got = queries()[name](spark, SF)
    want = spark.read.parquet(f"{SF}/{source}.parquet").selectExpr(f"{column} AS {key}")
    assert want.subtract(got.select(key)).isEmpty() and got.select(key).distinct().count() == want.distinct().count()


def test_every_input_row(spark):
    pages, documents = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    assert queries()["s8_aggregation"](spark, SF).count() == pages.select("url").distinct().count()
    assert queries()["k8_insert_or_ignore"](spark, SF).first()["ids"] == documents.select("doc_id").distinct().count()


def test_addresses_with_references(spark):
    got = {r.url for r in queries()["s12_sitemap"](spark, SF).filter("kind = 'page'").collect()}
    assert got == {r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


@pytest.fixture
def lake(spark, tmp_path):
    """Writes texts as the table of documents and gives the folder."""

    def put(texts):
        rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put


def runs(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_minhash_of_whole_texts(spark, lake):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    head, body = line(500), line(4000)
    texts = [head + " " + line(4000), head + " " + line(4000), line(400) + " " + body, line(400) + " " + body, body + " end", "only two" + " " * 50, "only two" + " " * 60, " " * 60]
    got = {(r.a, r.b): r.estimate for r in queries()["d3_minhash_pairs"](spark, lake(texts)).collect()}
    jaccard = {(a, b): len(runs(texts[a]) & runs(texts[b])) / len(runs(texts[a]) | runs(texts[b])) for a in range(7) for b in range(a + 1, 7)}
    assert len(head) > 2000 and jaccard[0, 1] < 0.1 and jaccard[2, 3] > 0.8
    assert got.keys() == {pair for pair, j in jaccard.items() if j >= 0.8}
    assert all(abs(got[pair] - jaccard[pair]) < 0.16 for pair in got)


def test_minhash_estimates(spark):
    words = [[f"w{k}" for k in range(i * 10, i * 10 + 400)] for i in range(6)]
    signed = {r.id: r.sig for r in dedup.minhash(spark.createDataFrame(list(enumerate(words)), "id bigint, words array<string>"), 512).collect()}
    for a in range(6):
        for b in range(a):
            shared = 400 - 10 * (a - b) - 2
            assert abs(sum(x == y for x, y in zip(signed[a], signed[b])) / 512 - shared / (796 - shared)) < 0.08


def test_classes_in_one_pass(spark, tmp_path):
    """the words of a text are taken once, not a pattern for each word and column; words at ends, phrases, signs between."""
    import contextlib
    import io

    texts = ["tion", "THER-thon, xtion tionx", "the anea of anea ofs oned theft", "eriner;erin_ thble than", "", None, "é" + "tion", "tion ther thon erin attion onin thes"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries()["f14_classify"](spark, str(tmp_path))
    got = {r.doc_id: (r.primary, r.secondary, r.confidence, r.keywords) for r in df.collect()}
    none = ("Technology", "", 0.3, "")
    assert got == {0: ("alpha", "", 0.6, "tion"), 1: ("alpha", "", 0.7, "ther|thon"), 2: ("gamma", "omega", 0.7, "anea of|oned the"), 3: ("beta", "delta|omega", 0.8, "eriner|than|thble"), 4: none, 5: none, 6: none, 7: ("alpha", "delta|gamma", 0.9, "attion|erin|onin|ther|thes")}
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    assert plan.getvalue().lower().count("regexp_extract_all(") + plan.getvalue().count("RLIKE") < 10

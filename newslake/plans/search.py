"""Queries of search (section 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.lake import scratch_dir
from newslake.lexicons import CORPUS_TAXONOMY
from newslake.plans import sql as S
from newslake.plans.registry import query
from newslake.plans.scalars import articles
from newslake.search import engine as E
from newslake.search.index import TextIndex
from newslake.sources.adapters import table


@query(f"WITH {S.ARTICLES} SELECT doc_id FROM art WHERE title ILIKE '%thon%' OR clean_text ILIKE '%attion the%' ORDER BY discovered_at DESC, doc_id LIMIT 100")
def q1_like(spark, sf_dir):
    a = articles(spark, sf_dir)
    hits = E.like(a.withColumn("b", F.lit("")), "thon", ["title"]).select("doc_id", "discovered_at").union(E.like(a, "attion the", ["clean_text"]).select("doc_id", "discovered_at")).distinct()
    return hits.orderBy(F.desc("discovered_at"), "doc_id").limit(100).select("doc_id")


@query(rf"""WITH {S.ARTICLES}, w AS (SELECT doc_id, {S.words('title')} AS a, {S.words('clean_text')} AS b FROM art), c AS (SELECT doc_id, len(a) + len(b) AS n,
CAST(len(list_filter(a, lambda x: starts_with(x, 'thon'))) * 5 + len(list_filter(b, lambda x: starts_with(x, 'thon'))) AS DOUBLE) AS t0, CAST(len(list_filter(a, lambda x: starts_with(x, 'erin'))) * 5 + len(list_filter(b, lambda x: starts_with(x, 'erin'))) AS DOUBLE) AS t1 FROM w),
s AS (SELECT count(*) AS nn, avg(n) AS an, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT doc_id, round(greatest(1e-6, ln((nn - d0 + 0.5) / (d0 + 0.5))) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / an)) + greatest(1e-6, ln((nn - d1 + 0.5) / (d1 + 0.5))) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / an)), 6) AS score FROM c, s WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def q2_bm25(spark, sf_dir):
    return E.bm25(articles(spark, sf_dir), "thon erin", {"title": 5.0, "clean_text": 1.0}, k=50)


@query(rf"""WITH {S.ARTICLES}, w AS (SELECT doc_id, {S.words('title')} AS a, {S.words('clean_text')} AS b, {S.words("coalesce(lang, '')")} AS c FROM art WHERE doc_id % 7 <> 3), t AS (SELECT doc_id, len(a) + len(b) + len(c) AS n,
CAST(len(list_filter(a, lambda x: starts_with(x, 'thon'))) * 5 + len(list_filter(b, lambda x: starts_with(x, 'thon'))) + len(list_filter(c, lambda x: starts_with(x, 'thon'))) * 3 AS DOUBLE) AS t0, CAST(len(list_filter(a, lambda x: x = 'en')) * 5 + len(list_filter(b, lambda x: x = 'en')) + len(list_filter(c, lambda x: x = 'en')) * 3 AS DOUBLE) AS t1 FROM w),
s AS (SELECT count(*) AS nn, avg(n) AS an, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM t)
SELECT doc_id, round(greatest(1e-6, ln((nn - d0 + 0.5) / (d0 + 0.5))) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / an)) + greatest(1e-6, ln((nn - d1 + 0.5) / (d1 + 0.5))) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / an)), 6) AS score FROM t, s WHERE t0 > 0 AND t1 > 0""")
def q2_indexed(spark, sf_dir):
    """Q2 through the kept index: all documents in two batches, some replaced, some (a seventh, as a user's erasure would) deleted."""
    a = articles(spark, sf_dir)
    index = TextIndex(spark, scratch_dir(spark), {"title": 5.0, "clean_text": 1.0, "tags": 3.0})
    index.add(a.filter("doc_id % 3 = 0").withColumn("clean_text", F.lit("an earlier version")).unionByName(a.filter("doc_id % 3 = 1")))
    index.add(a.filter("doc_id % 3 <> 1"))
    index.delete(a.filter("doc_id % 7 = 3"))
    return index.search('thon "en"')


@query(rf"WITH {S.ARTICLES}, w AS (SELECT doc_id, source_name, list_distinct({S.words('title')}) AS a, list_distinct({S.words('clean_text')}) AS b FROM art WHERE lang IN ('en', 'fr') AND doc_id >= 10 AND source_name NOT IN ('src3')), s AS (SELECT doc_id, round(greatest((CASE WHEN list_contains(a, 'thon') OR list_contains(a, 'ther') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(a, 'erin') THEN 1.0 ELSE 0 END) / 2 * 3, (CASE WHEN list_contains(b, 'thon') OR list_contains(b, 'ther') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(b, 'erin') THEN 1.0 ELSE 0 END) / 2), 6) AS score FROM w) SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.5 ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5")
def q3_builder(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("lang", F.col("tags")[0])
    s = E.Search().match("thon erin", title=3.0, clean_text=1.0).also(thon=["ther"]).term("lang", "en", "fr").span("doc_id", low=10).without("source_name", "src3").min_score(0.5).paged(5, 20)
    return s.build(a).select("doc_id", "score")


@query(rf"WITH {S.ARTICLES}, w AS (SELECT doc_id, {S.words('title')} AS a FROM art) SELECT doc_id FROM w WHERE len(list_filter(a, lambda x: {S.one_edit('x', 'thonan')})) > 0")
def q4_fuzzy(spark, sf_dir):
    """Q4: titles with a word within an edit of the query's."""
    return articles(spark, sf_dir).filter(F.exists(T.words(F.col("title")), lambda x: F.levenshtein(x, F.lit("thonan")) <= 1)).select("doc_id")


@query(rf"WITH {S.ARTICLES} SELECT source_name, count(*) AS n FROM art WHERE list_contains({S.words('clean_text')}, 'thon') GROUP BY source_name ORDER BY n DESC, source_name LIMIT 20")
def q3_facets(spark, sf_dir):
    return E.Search().match("thon", clean_text=1.0).facet(articles(spark, sf_dir), "source_name")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q) SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 25")
def q5_semantic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = e.filter("vec_id = 7").select("embedding").first()
    return E.semantic(e, list(found[0]) if found else [1.0], 25)


@query(rf"WITH {S.ARTICLES}, c AS (SELECT doc_id, len(regexp_extract_all(lower(title), 'thon')) AS a, len(regexp_extract_all(lower(clean_text), 'thon')) AS b, len(regexp_extract_all(lower(title), 'er')) AS d, len(regexp_extract_all(lower(clean_text), 'er')) AS e FROM art) SELECT doc_id, CAST(3 * (a + d) + b + e AS BIGINT) AS rank FROM c WHERE a + b > 0 AND d + e > 0 ORDER BY rank DESC, doc_id LIMIT 100")
def q9_term_counts(spark, sf_dir):
    n = lambda c, w: F.regexp_count(F.lower(c), F.lit(w))
    a = articles(spark, sf_dir).select("doc_id", n("title", "thon").alias("a"), n("clean_text", "thon").alias("b"), n("title", "er").alias("d"), n("clean_text", "er").alias("e"))
    return a.filter("a + b > 0 AND d + e > 0").select("doc_id", (3 * (F.col("a") + F.col("d")) + F.col("b") + F.col("e")).cast("bigint").alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(100)


@query(rf"WITH {S.ARTICLES} SELECT doc_id, title, source_name AS source, lang AS language, CAST(epoch(discovered_at) AS BIGINT) AS published, CAST(len({S.words('clean_text')}) AS BIGINT) AS n_words FROM art")
def q8_search_document(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", "title", F.col("source_name").alias("source"), F.col("tags")[0].alias("language"), F.unix_timestamp("discovered_at").alias("published"), F.size(T.words(F.col("clean_text"))).cast("bigint").alias("n_words"))


@query("SELECT * FROM (VALUES ('quantum computing', 'search', false, '\"quantum\"* \"computing\"*'), ('thon erin', 'search', true, '\"thon\"* \"erin\"*'), ('https://x.example.com', 'url', true, '\"https\"* \"x\"* \"example\"* \"com\"*'), ('trending now', 'trending', true, '\"trending\"* \"now\"*'), ('\"exact words\" tion', 'search', true, '\"exact words\" \"tion\"*'), ('x', 'invalid', false, '\"x\"*')) t(query, intent, accepted, match)")
def f24_query_analysis(spark, sf_dir):
    """parsed on the driver, as the queries are typed by people."""
    vocabulary = [w for ws in CORPUS_TAXONOMY.values() for w in ws]
    asked = ["quantum computing", "thon erin", "https://x.example.com", "trending now", '"exact words" tion', "x"]
    rows = [(a.query, a.intent, a.accepted, E.match_expression(x)) for x in asked for a in [E.analyzed(x, vocabulary, {})]]
    return spark.createDataFrame(rows, "query string, intent string, accepted boolean, match string")

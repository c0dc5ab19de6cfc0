"""Queries of rows that share an operator with others or stand alone: pages, adapters, repositories, windows, verbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import text as T
from newslake.functions import url as U
from newslake.lake import scratch_dir, written
from newslake.lexicons import CORPUS_NEGATIVE, CORPUS_POSITIVE
from newslake.operators import stages as G
from newslake.operators import store as K
from newslake.plans import sql as S
from newslake.plans.aggregates import attempts
from newslake.plans.events import evidence
from newslake.plans.registry import query
from newslake.plans.scalars import _sent, articles, now
from newslake.search import engine as E
from newslake.sources import feeds as FE
from newslake.sources import markup as M
from newslake.sources import pages as P
from newslake.sources.adapters import page_observations, table


def _page(*parts) -> F.Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _id() -> F.Column:
    return F.col("page_id")


@query("SELECT page_id, CAST(k AS INTEGER) AS pos, '/story/' || page_id || '/' || k AS href, 'Story number ' || k || ' of page ' || page_id AS title FROM pages, range(0, 3) t(k) WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 0, '/plain/' || page_id, 'a plain link with enough words ' || page_id FROM pages WHERE page_id % 2 <> 0")
def s6_listing(spark, sf_dir):
    """Headed links on even pages, links by their text on odd ones; menus, short titles and repeats go."""
    story = lambda k: _page(f"<h2><a href='/story/", _id(), f"/{k}'>Story number {k} of page ", _id(), "</a></h2>")
    headed = F.concat(*(story(k) for k in (0, 1, 2)), story(1), F.lit("<h3><a href='/s'>Too short</a></h3><p><a href='/p'>a plain link with enough words</a></p>"))
    plain = _page("<nav><a href='/n'>a menu link with many words</a></nav><p><a href='/plain/", _id(), "'>a plain link with enough words ", _id(), "</a> <a href='/t'>tiny</a></p>")
    return P.listed(table(spark, sf_dir, "pages").select("page_id", F.when(_id() % 2 == 0, headed).otherwise(plain).alias("html")))


@query("SELECT page_id, CAST(k AS INTEGER) AS pos, '/d/' || k AS href, 'Head ' || k || ' of ' || page_id AS title FROM pages, range(0, 2) t(k)")
def s7_directory(spark, sf_dir):
    """The first selector that finds any wins, with links in or around the headline."""
    made = _page("<a href='/d/0'><b class='hd'>Head 0 of ", _id(), "</b></a><div><b class='x hd'><a href='/d/1'>Head 1 of ", _id(), "</a></b></div><h3>other</h3>")
    return P.directory(table(spark, sf_dir, "pages").select("page_id", made.alias("html")), [".missing", "b.hd", "h3"])


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'selector' WHEN 1 THEN 'density' WHEN 2 THEN 'paywall' ELSE '' END AS method, CASE page_id % 4 WHEN 0 THEN trim(repeat('word ', 60)) || ' ' || page_id WHEN 1 THEN trim(repeat('text ', 60)) || chr(10) || page_id ELSE '' END AS text FROM pages")
def h2_deep_text(spark, sf_dir):
    i = _id() % 4
    html = F.when(i == 0, _page("<article><nav>menu</nav>" + "word " * 60, _id(), "</article>")).when(i == 1, _page("<div><p>" + "text " * 60 + "</p><p>", _id(), "</p></div>")).when(i == 2, F.lit("<article>" + "word " * 45 + "unlock this story</article>"))
    return P.deep_texts(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query()
def h2_deep_pages(spark, sf_dir):
    """H2 over the pages themselves."""
    return P.deep_texts(table(spark, sf_dir, "pages"))


@query("SELECT page_id, 0 AS pos, '/news/' || page_id || '/2024/01/a-slug-of-words' AS href, 'read all of it now' AS anchor, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id >= 10000 THEN 1.0 ELSE 1.0 END ELSE CASE WHEN page_id >= 10000 THEN 1.0 ELSE 0.8 END END AS score FROM pages")
def h5_context_links(spark, sf_dir):
    link = _page("<a href='/news/", _id(), "/2024/01/a-slug-of-words'>read all of it now</a>")
    html = F.when(_id() % 2 == 0, F.concat(F.lit("<main><p>some words stand around it "), link, F.lit("</p></main>"))).otherwise(link)
    return P.linked_in_context(table(spark, sf_dir, "pages").select("page_id", F.concat(html, F.lit("<a href='/about'>About</a>")).alias("html")))


@query("SELECT page_id, 'the longer block of page ' || page_id AS block, 'body ' || page_id AS json FROM pages")
def h7_blocks(spark, sf_dir):
    made = _page("<div>short<section>the longer block<p>of page ", _id(), "</p></section></div><script type='application/json'>{\"x\":[{\"body\":\"body ", _id(), "\"},{\"title\":\"not this longer one\"}]}</script>")
    return P.blocks(table(spark, sf_dir, "pages").select("page_id", made.alias("html")))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || CASE k WHEN 0 THEN '/news/' || page_id || '/story' ELSE '/other' END AS target, CASE k WHEN 0 THEN 0.76 ELSE 0.38 END AS score FROM pages, range(0, 2) t(k)")
def p12_article_links(spark, sf_dir):
    """Links that look like articles, by address or anchor, and score 0.2 or more."""
    made = _page("<a href='/news/", _id(), "/story'>read this</a><a href='/about/x'>About us and all of our people</a><a href='/other'>one two three four five six</a><a href='/more'>short</a>")
    links = M.scored_links(M.html_links(table(spark, sf_dir, "pages").select("page_id", "url", made.alias("html"))))
    return links.filter("article AND score >= 0.2").select("page_id", "target", "score")


@query("SELECT page_id AS feed_id, CAST(i AS INTEGER) AS i, 'Corp news ' || i AS title, 1 AS source_tier, true AS is_primary FROM pages, range(1, 3) t(i)")
def s3_corporate_feed(spark, sf_dir):
    """S3: entries of a company's feed, of the first tier and primary."""
    xml = F.lit("<rss><channel>" + "".join(f"<item><title>Corp news {i}</title><link>https://c.example.com/{i}</link></item>" for i in (1, 2)) + "</channel></rss>")
    return FE.corporate_entries(table(spark, sf_dir, "pages").select(_id().alias("feed_id"), xml.alias("xml")), now()).select("feed_id", "i", "title", "source_tier", "is_primary")


@query("SELECT page_id, kind, CASE kind WHEN 'newsapi' THEN 'N' || page_id WHEN 'duckduckgo' THEN 'D' || page_id ELSE 'first line' END AS title, 'https://' || kind || '.example.com/' || page_id AS url, CASE kind WHEN 'newsapi' THEN 'Paper' WHEN 'duckduckgo' THEN 'DuckDuckGo' ELSE '@writer' END AS source FROM pages, (VALUES ('newsapi'), ('duckduckgo'), ('x')) t(kind)")
def s9_adapters(spark, sf_dir):
    """Records of three interfaces as one shape."""
    p = table(spark, sf_dir, "pages").select("page_id")
    made = {
        "newsapi": _page('{"title":"N', _id(), '","url":"https://newsapi.example.com/', _id(), '","source":{"name":"Paper"},"publishedAt":"2024-01-05T10:00:00Z"}'),
        "duckduckgo": _page('{"title":"D', _id(), '","href":"https://duckduckgo.example.com/', _id(), '","body":"b"}'),
        "x": _page('{"text":"first line\\nsecond","id":"https://x.example.com/', _id(), '","author":{"username":"writer"}}'),
    }
    return reduce(DataFrame.unionByName, (FE.adapted(p.select("page_id", v.alias("json")), k).select("page_id", F.lit(k).alias("kind"), "title", "url", "source") for k, v in made.items()))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 4 + 1 AS INTEGER) AS tier, row_number() OVER (ORDER BY c_custkey % 4 + 1, c_name) AS place FROM customer")
def s15_registry(spark, sf_dir):
    """A JSON registry written and read in order of tier and name."""
    path = scratch_dir(spark)
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("u").alias("url"), (F.col("c_custkey") % 4 + 1).cast("int").alias("tier"), F.lit("rss").alias("kind")).write.json(path)
    ordered = FE.registry(spark, path)
    return ordered.select("id", "tier", F.row_number().over(Window.orderBy("tier", "name")).cast("bigint").alias("place"))  # a registry is small


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'labels', count(*) FROM labels")
def s16_tables(spark, sf_dir):
    """Tables of a store as sources, by name; ``FE.database`` reads them over JDBC where a driver is there."""
    names = ["region", "nation", "supplier", "customer", "labels"]
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names))


@query("SELECT count(*) AS samples, round(avg(value), 4) AS mean_rss, max(CAST(event_id AS DOUBLE)) AS last_second FROM events WHERE event_id % 10 <> 0")
def s17_telemetry(spark, sf_dir):
    """A CSV of samples; rows that do not parse are left out."""
    path = scratch_dir(spark)
    bad = F.col("event_id") % 10 == 0
    e = table(spark, sf_dir, "events").select(F.when(bad, "x").otherwise(F.col("event_id").cast("double").cast("string")).alias("elapsed_seconds"), F.col("value").cast("string").alias("rss_mb"), F.lit("1").alias("vms_mb"), F.lit("2").alias("cpu_percent"), F.lit("3").alias("num_fds"))
    e.write.option("header", True).csv(path)
    return FE.telemetry(spark, path).agg(F.count("elapsed_seconds").alias("samples"), F.round(F.avg("rss_mb"), 4).alias("mean_rss"), F.max("elapsed_seconds").alias("last_second"))


@query(f"WITH {S.ARTICLES}, g AS (SELECT doc_id, CASE WHEN length(title) < 15 THEN 'TITLE_TOO_SHORT' WHEN {S.word_count('clean_text')} < 20 THEN 'TOO_FEW_WORDS' WHEN {S.minutes('discovered_at', 'TIMESTAMP ' + chr(39) + '2024-01-03' + chr(39))} > 2400 THEN 'TOO_OLD' ELSE 'OK' END AS standard, length(title) < 30 AS a, {S.word_count('clean_text')} < 60 AS b FROM art) SELECT doc_id, standard, CASE WHEN standard <> 'OK' THEN standard WHEN a THEN 'TITLE_TOO_SHORT' WHEN b THEN 'TOO_FEW_WORDS' ELSE 'OK' END AS strict FROM g")
def p7_gates(spark, sf_dir):
    """Reason codes of the standard and the strict gate."""
    hours = D.minutes_between(F.col("discovered_at"), F.lit("2024-01-03").cast("timestamp")) / 60
    a = articles(spark, sf_dir)
    return a.select("doc_id", G.gate(F.col("title"), F.col("clean_text"), hours, 40.0).alias("standard"), G.gate(F.col("title"), F.col("clean_text"), hours, 40.0, strict=True).alias("strict"))


BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]


@query("SELECT event_type, b AS bucket, count(*) FILTER (value <= b AND value > lo) AS n FROM events, (VALUES " + ", ".join(f"({b}::DOUBLE, {a}::DOUBLE)" for a, b in zip([-1.0, *BUCKETS], BUCKETS)) + ") t(b, lo) GROUP BY event_type, b")
def a14_metrics(spark, sf_dir):
    """Eight buckets of 0.1 to 60 seconds, each counted by itself."""
    lows = [-1.0, *BUCKETS]
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array(*(F.struct(F.lit(b).alias("bucket"), F.count_if((F.col("value") <= b) & (F.col("value") > a)).alias("n")) for a, b in zip(lows, BUCKETS))).alias("x"))
    return sums.select("event_type", F.explode("x").alias("x")).select("event_type", "x.bucket", "x.n")


@query(f"WITH {S.ARTICLES}, p AS (SELECT a.doc_id, list_distinct({S.words('a.title')}) AS x, list_distinct({S.words('b.title')}) AS y FROM art a JOIN art b ON b.doc_id = a.doc_id + 1) SELECT doc_id, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, CAST(len(list_distinct(list_concat(x, y))) AS INTEGER) AS every, CAST(len(x) - len(list_intersect(x, y)) AS INTEGER) AS own FROM p")
def u2_set_algebra(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", F.array_distinct(T.words(F.col("title"))).alias("x"))
    p = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    return p.select("doc_id", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("every"), F.size(F.array_except("x", "y")).alias("own"))


@query(f"WITH {S.ATTEMPTS}, i AS (SELECT *, count(*) FILTER (success) OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM att), r AS (SELECT event_id, source_id, ts, success, island FROM i) SELECT event_id, count(*) OVER w AS frame, count(*) FILTER (success) OVER w AS ok, CASE WHEN success THEN 0 ELSE row_number() OVER (PARTITION BY source_id, island, success ORDER BY ts, event_id) END AS failing FROM r WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def w1_health_frames(spark, sf_dir):
    """At each attempt the last hundred of its source, and how many failed in a row up to it."""
    order = Window.partitionBy("source_id").orderBy("ts", "event_id")
    last = order.rowsBetween(-99, 0)
    rows = attempts(spark, sf_dir).withColumn("island", F.count_if("success").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("source_id", "island", "success").orderBy("ts", "event_id"))
    return rows.select("event_id", F.count("*").over(last).alias("frame"), F.count_if("success").over(last).alias("ok"), F.when(F.col("success"), 0).otherwise(run).cast("bigint").alias("failing"))


@query(f"WITH {S.ARTICLES}, f AS (SELECT doc_id % 7 AS event_id, lower(trim(source_name)) AS publisher, min(doc_id) AS first_id FROM art GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY first_id) AS place FROM f) SELECT event_id, publisher, place FROM k WHERE place > 1")
def w3_corroboration(spark, sf_dir):
    """Publishers of an event in order of their first article; the opening one does not corroborate."""
    rows = evidence(spark, sf_dir).withColumn("event_id", F.col("article_id") % 7)  # sources repeat by 20: 7 mixes them
    first = rows.groupBy("event_id", F.lower(F.trim("source_name")).alias("publisher")).agg(F.min(F.struct("discovered_at", "article_id")).alias("f"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy("f")).cast("bigint")).filter("place > 1").select("event_id", "publisher", "place")


@query("WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM k WHERE k <= greatest(1, n // 3) GROUP BY event_type")
def w5_newest_third(spark, sf_dir):
    own = Window.partitionBy("event_type")
    k = table(spark, sf_dir, "events").withColumns({"k": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("event_id"))), "total": F.count("*").over(own)})
    return k.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("total") / 3))).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {S.ARTICLES}, k AS (SELECT source_name, doc_id, row_number() OVER (PARTITION BY source_name ORDER BY length(clean_text) DESC, doc_id) AS place FROM art) SELECT source_name, doc_id, place FROM k WHERE place <= 3")
def w7_top_of_facets(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(F.length("clean_text").desc(), "doc_id"))
    return articles(spark, sf_dir).select("source_name", "doc_id", place.cast("bigint").alias("place")).filter("place <= 3")


_REST = """regexp_replace(t, '"[^"]*"?', ' ', 'g')"""


@query(rf"""WITH {S.ARTICLES}, x AS (SELECT doc_id, '"' || title || '" AND ' || title || ' NOT *' AS t FROM art WHERE NOT contains(title, '"')), y AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '"([^"]+)"', 1), lambda p: lower(trim(p))), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}_]')) AS p, list_filter(regexp_extract_all({_REST}, '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains(['AND', 'OR', 'NOT', 'NEAR'], w)) AS w FROM x) SELECT doc_id, array_to_string(list_concat(list_transform(p, lambda a: '"' || a || '"'), list_transform(w, lambda a: '"' || lower(a) || '"*')), ' ') AS match FROM y""")
def f10_sanitized(spark, sf_dir):
    """F10 as columns: phrases stay, operators go, other words match as prefixes."""
    a = articles(spark, sf_dir).filter(~F.col("title").contains('"'))
    return a.select("doc_id", E.sanitized(F.concat(F.lit('"'), "title", F.lit('" AND '), "title", F.lit(" NOT *"))).alias("match"))


@query("SELECT page_id, CAST(epoch(CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-05' WHEN 1 THEN TIMESTAMP '2024-01-31 22:00:00' ELSE TIMESTAMP '2023-12-07' END) AS BIGINT) AS published FROM pages")
def t2_page_dates(spark, sf_dir):
    """A date of the page's address, a relative one, and a written one."""
    i = _id() % 3
    text, url = F.when(i == 1, "2 hours ago").when(i == 2, "December 7, 2023").otherwise("no date"), F.when(i == 0, "https://a.example.com/2024/1/5/x").otherwise("https://a.example.com/x")
    return table(spark, sf_dir, "pages").select("page_id", F.unix_timestamp(D.parsed(text, now(), url)).alias("published"))


@query(f"WITH {S.ARTICLES}, a AS (SELECT doc_id, {S.minutes('discovered_at', 'TIMESTAMP ' + chr(39) + '2024-01-01 12:00:00' + chr(39))} AS age FROM art) SELECT doc_id, CASE WHEN age < 15 THEN 'just_now' WHEN age < 60 THEN 'last_hour' WHEN age < 360 THEN 'last_6_hours' WHEN age < 1440 THEN 'today' WHEN age < 10080 THEN 'this_week' ELSE 'older' END AS shown FROM a")
def t4_shown_freshness(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", D.shown_freshness(D.minutes_between(F.col("discovered_at"), F.lit("2024-01-01 12:00:00").cast("timestamp"))).alias("shown"))


@query("SELECT event_id, round(greatest(10.0, least(90.0, value)), 4) AS clamped, CAST(ceil(-event_id * ln(0.001) / (ln(2) * ln(2))) AS BIGINT) AS bloom_bits, round(exp(-value / 100), 6) AS decay FROM events WHERE event_id > 0")
def m1_math(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id > 0")
    return e.select("event_id", F.round(F.greatest(F.lit(10.0), F.least(F.lit(90.0), "value")), 4).alias("clamped"), F.ceil(-F.col("event_id") * F.ln(F.lit(0.001)) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0)))).alias("bloom_bits"), F.round(F.exp(-F.col("value") / 100), 6).alias("decay"))


@query(f"WITH {S.ARTICLES}, e AS (SELECT doc_id % 100 AS event_id, doc_id AS article_id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY discovered_at, doc_id) AS pos, count(*) OVER (PARTITION BY doc_id % 100 ORDER BY discovered_at, doc_id ROWS UNBOUNDED PRECEDING) AS sources_so_far, discovered_at FROM art) SELECT event_id, article_id, pos, sources_so_far, CASE WHEN pos = 1 THEN 'detected' ELSE 'updated' END AS status FROM e")
def c2_timeline(spark, sf_dir):
    """An event's sources in order of time, as rows, with what it had by then."""
    order = Window.partitionBy("event_id").orderBy("discovered_at", "article_id")
    pos = F.row_number().over(order).cast("bigint")
    upto = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return evidence(spark, sf_dir).select("event_id", "article_id", pos.alias("pos"), upto.alias("sources_so_far"), F.when(pos == 1, "detected").otherwise("updated").alias("status"))


@query("SELECT event_id, event_type = 'error' AND value >= 70 AND value % 10 >= 6 AS breaking FROM events")
def c7_breaking(spark, sf_dir):
    """Breaking needs the freshest level, confidence of 0.70 and importance of 0.60."""
    fresh = F.when(F.col("event_type") == "error", "breaking").otherwise("fresh")
    return table(spark, sf_dir, "events").select("event_id", G.is_breaking(fresh, F.col("value") / 100, (F.col("value") % 10) / 10).alias("breaking"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'attion') OR contains(lower(coalesce(source, '')), 'attion')")
def q6_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.lower(F.coalesce("text", F.lit(""))).contains("attion") | F.lower(F.coalesce("source", F.lit(""))).contains("attion")).select("doc_id")


@query(f"WITH {S.ARTICLES} SELECT doc_id, CAST(len(list_filter({S.words('title')}, lambda w: starts_with(w, 'th'))) AS INTEGER) AS n FROM art WHERE len(list_filter({S.words('title')}, lambda w: starts_with(w, 'th'))) > 0")
def q7_prefix(spark, sf_dir):
    n = F.size(F.filter(T.words(F.col("title")), lambda w: w.startswith("th")))
    return articles(spark, sf_dir).select("doc_id", n.alias("n")).filter("n > 0")


_HIT = "len(list_filter({w}, lambda x: {edit})) > 0"


def _score(words: str) -> str:
    hit = lambda q: _HIT.format(w=words, edit=S.one_edit("x", q))
    return f"(CASE WHEN {hit('thonan')} OR {hit('therin')} THEN 1.0 ELSE 0.0 END + CASE WHEN {hit('erin')} THEN 1.0 ELSE 0.0 END) / 2"


@query(f"WITH {S.ARTICLES}, w AS (SELECT doc_id, list_distinct({S.words('title')}) AS a, list_distinct({S.words('clean_text')}) AS b FROM art), s AS (SELECT doc_id, round(greatest(3 * {_score('a')}, {_score('b')}), 6) AS score FROM w) SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100")
def q4_client(spark, sf_dir):
    """Q4: several fields with boosts, words within one edit, synonyms."""
    return E.Search().match("thonan erin", fuzzy=1, title=3.0, clean_text=1.0).also(thonan=["therin"]).paged(0, 100).build(articles(spark, sf_dir)).select("doc_id", "score")


@query("SELECT DISTINCT url FROM pages WHERE page_id % 2 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def d10_add_if_new(spark, sf_dir):
    """Addresses that are not held yet, exactly; a Bloom filter (``d9_bloom``) may screen before."""
    p = table(spark, sf_dir, "pages")
    return p.filter("page_id % 2 <> 0").select("url").distinct().join(p.filter("page_id % 2 = 0").select("url"), "url", "left_anti")


@query(f"WITH {S.ATTEMPTS}, k AS (SELECT source_id, status_code, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS k FROM att) SELECT CASE WHEN status_code = 200 THEN 'healthy' WHEN status_code = 429 THEN 'limited' ELSE 'failing' END AS status, count(*) AS sources FROM k WHERE k = 1 GROUP BY 1")
def k6_health_by_status(spark, sf_dir):
    """K6: records of two batches merged by source, then read by status."""
    a = attempts(spark, sf_dir)
    latest = lambda rows: rows.groupBy("source_id").agg(F.max(F.struct("ts", "event_id", "status_code")).alias("m")).select("source_id", "m.ts", "m.status_code")
    cut = F.lit("2024-01-15").cast("timestamp")
    held = K.upserted(latest(a.filter(F.col("ts") < cut)), latest(a.filter(F.col("ts") >= cut)), ["source_id"], "ts")
    status = F.when(F.col("status_code") == 200, "healthy").when(F.col("status_code") == 429, "limited").otherwise("failing")
    return held.groupBy(status.alias("status")).agg(F.count("*").alias("sources"))


@query("WITH a AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 20 AS item, event_type, ts, event_id FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS k FROM a WHERE event_type IN ('click', 'error')), h AS (SELECT user_id, count(DISTINCT item) AS read FROM a WHERE event_type = 'view' GROUP BY user_id), m AS (SELECT user_id, count(*) FILTER (k = 1 AND event_type = 'click') AS bookmarks FROM b GROUP BY user_id), p AS (SELECT user_id, arg_max(item, (ts, event_id)) AS preferred FROM a WHERE event_type = 'signup' GROUP BY user_id) SELECT u.user_id, coalesce(read, 0) AS read, coalesce(bookmarks, 0) AS bookmarks, preferred FROM (SELECT DISTINCT user_id FROM a) u LEFT JOIN h USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN p USING (user_id)")
def k7_preferences(spark, sf_dir):
    """K7: a user's preference (last write), bookmarks (added and removed) and reading history (each article once)."""
    a = table(spark, sf_dir, "events").select("user_id", (F.floor("value") % 20).alias("item"), "event_type", "ts", "event_id")
    return K.user_state(a, written)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, CAST(sum(o_custkey) AS BIGINT) AS owners FROM orders")
def k9_migration(spark, sf_dir):
    """K9: rows of an older store go in unless their key is there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    moved = K.inserted_or_ignored(o.filter("o_orderkey % 3 <> 0"), o.unionByName(o), ["o_orderkey"])
    return moved.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"), F.sum("o_custkey").cast("bigint").alias("owners"))


@query("WITH g AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT event_id, CAST(floor(coalesce(gap, 0) / 15) AS BIGINT) AS pings, coalesce(gap > 3600, false) AS stale FROM g")
def r5_pings(spark, sf_dir):
    """On a channel a ping for each 15 idle seconds, and whether it had gone stale before the event."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    return table(spark, sf_dir, "events").select("event_id", gap.alias("gap")).select("event_id", F.floor(F.coalesce("gap", F.lit(0.0)) / 15).alias("pings"), F.coalesce(F.col("gap") > 3600, F.lit(False)).alias("stale"))


@query("WITH g AS (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 48 HOURS, true) AS opens FROM events), s AS (SELECT user_id, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL")
def r12_sessions(spark, sf_dir):
    """An event expires 48 hours after its last activity; what comes later opens a new one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    rows = table(spark, sf_dir, "events").withColumn("opens", F.coalesce(gap > 48 * 3600 * 1_000_000, F.lit(True)))
    session = F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("user_id", session.alias("session")).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT mode, count(*) AS rows, count(*) FILTER (mode = 'active' AND page_id % 3 <> 0) AS published FROM pages, (VALUES ('shadow'), ('active'), ('legacy')) t(mode) GROUP BY mode")
def r13_modes(spark, sf_dir):
    """A shadow run judges all and publishes nothing; an active one publishes what passed; a legacy one leaves it to the old chain."""
    p = table(spark, sf_dir, "pages").select((_id() % 3 != 0).alias("passed"))
    modes = (G.published(p, m).agg(F.lit(m).alias("mode"), F.count("*").alias("rows"), F.count_if("published").alias("published")) for m in ("shadow", "active", "legacy"))
    return reduce(DataFrame.unionByName, modes)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def r1_stream_channels(spark, sf_dir):
    """Each event once by its id within the watermark, split by channel; the counts would show a lost or repeated one."""
    from newslake.streaming import jobs

    twice = jobs.file_stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = jobs.available(jobs.idempotent(twice, ["event_id"], "60 days"), "append")
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {S.ARTICLES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fallback' ELSE 'enriched' END AS status, CASE WHEN doc_id % 5 = 0 THEN substring(title, 1, 20) ELSE upper(substring(lang, 1, 2)) || ' ' || length(title) END AS note FROM art WHERE lang IS NOT NULL")
def udf_enricher(spark, sf_dir):
    """Section 2.14: a pluggable enricher; where it fails or answers nothing, the row keeps a fallback and says so."""
    a = articles(spark, sf_dir).withColumn("lang", F.col("tags")[0]).filter("lang IS NOT NULL")
    return G.enriched(a.select("doc_id", "title", "lang"), _note, F.substring("title", 1, 20)).select("doc_id", "status", "note")


def _note(row) -> str:  # noqa: ANN001
    if row.doc_id % 5 == 0:
        raise TimeoutError("no answer")
    return f"{row.lang[:2].upper()} {len(row.title)}"


@query(f"WITH {S.PAGES}, a AS (SELECT page_id, {S.canonical('url')} AS c FROM obs), w AS (SELECT page_id AS wanted, CASE WHEN page_id % 2 = 0 THEN page_id END AS id, c AS address FROM a), f AS (SELECT w.wanted, min(a.page_id) AS found FROM w JOIN a ON a.page_id = w.id OR w.id IS NULL AND a.c = w.address GROUP BY w.wanted) SELECT wanted, found FROM f")
def verb_get(spark, sf_dir):
    """Section 2.15: by id, or by the canonical address where no id is given."""
    a = table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("c"))
    by_id = a.filter("page_id % 2 = 0").select(F.col("page_id").alias("wanted"), F.col("page_id").alias("found"))
    first = written(a.groupBy("c").agg(F.min("page_id").alias("found")))
    return by_id.unionByName(a.filter("page_id % 2 <> 0").join(first, "c").select(F.col("page_id").alias("wanted"), "found"))


@query(f"WITH {S.ARTICLES}, e AS (SELECT doc_id % 100 AS event_id, max(discovered_at) AS last, bool_or({S.has('lower(title)', 'thon')}) AS held FROM art GROUP BY 1) SELECT event_id FROM e WHERE held ORDER BY last DESC, event_id LIMIT 20")
def verb_events_of_entity(spark, sf_dir):
    """Section 2.15: the latest events that name an entity, up to a limit."""
    e = evidence(spark, sf_dir).groupBy("event_id").agg(F.max("discovered_at").alias("last"), F.bool_or(T.present(F.lower("title"), "thon")).alias("held"))
    return e.filter("held").orderBy(F.desc("last"), "event_id").limit(20).select("event_id")


@query(f"WITH {S.ARTICLES}, s AS (SELECT lang AS topic, date_trunc('hour', discovered_at) AS h, {_sent} AS x FROM art WHERE lang IS NOT NULL) SELECT topic, CAST(epoch(h) AS BIGINT) AS period, round(avg(x), 6) AS sentiment, count(*) AS n FROM s GROUP BY ALL")
def verb_sentiment_trend(spark, sf_dir):
    """Section 2.15: mean sentiment by topic and period."""
    s = articles(spark, sf_dir).select(F.col("tags")[0].alias("topic"), F.date_trunc("hour", "discovered_at").alias("h"), T.sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE).alias("x")).filter("topic IS NOT NULL")
    return s.groupBy("topic", F.unix_timestamp("h").alias("period")).agg(F.round(F.avg("x"), 6).alias("sentiment"), F.count("*").alias("n"))


@query(f"WITH {S.PAGES} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS pipeline FROM obs WHERE observed_at > TIMESTAMP '2024-01-31 00:30:00' ORDER BY observed_at DESC, page_id LIMIT 60")
def verb_feed_since(spark, sf_dir):
    """Section 2.15: the older feed: what came since a time, newest first, marked by the chain that made it."""
    o = page_observations(table(spark, sf_dir, "pages")).filter(F.col("observed_at") > F.lit("2024-01-31 00:30:00").cast("timestamp"))
    return o.orderBy(F.desc("observed_at"), "page_id").limit(60).select("page_id", F.when(_id() % 2 == 0, "new").otherwise("old").alias("pipeline"))

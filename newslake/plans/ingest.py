"""Queries of sources, markup and streams (sections 2.1, 2.8 and 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.lexicons import CORPUS_TAXONOMY
from newslake.operators import graph
from newslake.plans import sql as S
from newslake.plans.aggregates import attempts
from newslake.plans.registry import query
from newslake.plans.scalars import articles, joined, now
from newslake.sources import adapters as A
from newslake.sources import feeds as FE
from newslake.sources import markup as M
from newslake.sources.adapters import table
from newslake.streaming import jobs


@query("SELECT page_id AS feed_id, CAST(i AS INTEGER) AS i, 'Story ' || page_id || '-' || i AS title, 'https://f.example.com/' || page_id || '/' || i AS url, 'text ' || i AS summary, CAST(epoch(TIMESTAMP '2024-01-05 10:00:00') AS BIGINT) AS published FROM pages, range(1, 4) t(i)")
def s1_rss(spark, sf_dir):
    """S1."""
    return _rss(table(spark, sf_dir, "pages"))


def _rss(pages):
    item = lambda i: F.concat(F.lit("<item><title>Story "), F.col("page_id").cast("string"), F.lit(f"-{i}</title><link>https://f.example.com/"), F.col("page_id").cast("string"), F.lit(f"/{i}</link><description>text {i}</description><pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate></item>"))
    made = pages.select(F.col("page_id").alias("feed_id"), F.concat(F.lit("<rss><channel>"), *(item(i) for i in (1, 2, 3)), F.lit("</channel></rss>")).alias("xml"))
    return FE.feed_entries(made, now()).select("feed_id", "i", "title", "url", "summary", F.unix_timestamp("published_at").alias("published"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'CVE-2024-1234' WHEN 1 THEN '' ELSE 'CVE-2023-77777|CVE-2024-0001' END AS cves, CASE page_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'high' END AS severity FROM pages")
def s2_security(spark, sf_dir):
    text = F.when(F.col("page_id") % 3 == 0, "Critical bug cve-2024-1234, CVE-2024-1234").when(F.col("page_id") % 3 == 1, "a patch").otherwise("exploit of CVE-2023-77777 and CVE-2024-0001")
    c = FE.security_columns(text)
    return table(spark, sf_dir, "pages").select("page_id", joined(c["cves"]).alias("cves"), c["severity"].alias("severity"))


@query("SELECT page_id, 1 AS source_tier, true AS is_primary FROM pages")
def s3_corporate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("source_tier"), F.lit(True).alias("is_primary"))


@query("WITH l AS (SELECT user_id AS story_id, ts, value, value - lag(value) OVER w AS dv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT story_id, round(dv / dt, 6) AS velocity FROM l WHERE dt > 0 AND dv / dt > 2 AND value > 20")
def s4_hacker_velocity(spark, sf_dir):
    polls = table(spark, sf_dir, "events").select(F.col("user_id").alias("story_id"), "ts", F.col("value").alias("score"))
    return FE.velocity_hits(polls).select("story_id", F.round("velocity", 6).alias("velocity"))


@query("SELECT 'repo' || page_id AS repo, CAST(i AS INTEGER) AS i, 'repo' || page_id || ' v' || i || ' released' AS title FROM pages, range(0, 3) t(i)")
def s5_releases(spark, sf_dir):
    """S5."""
    return _releases(table(spark, sf_dir, "pages"))


def _releases(pages):
    made = pages.select(F.concat(F.lit("repo"), F.col("page_id").cast("string")).alias("repo"), F.to_json(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.concat(F.lit("v"), i.cast("string")).alias("tag"), F.lit("u").alias("url")))).alias("json"))
    return FE.releases(made).select("repo", "i", "title")


@query("WITH u AS (SELECT 'a' AS api, url, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'b', url, page_id FROM pages WHERE page_id % 2 <> 0 OR page_id % 3 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, api) AS k FROM u) SELECT api, page_id FROM f WHERE k = 1")
def s8_aggregation(spark, sf_dir):
    """S8 over every page: the even ones from one interface, the odd ones and some of the even ones from the other."""
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    return _aggregation(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 <> 0 OR page_id % 3 = 0"))


def _aggregation(a, b):
    from newslake.operators.dedup import first_wins

    both = a.withColumn("api", F.lit("a")).unionByName(b.withColumn("api", F.lit("b")))
    return first_wins(both, [F.col("url")], ["page_id", "api"]).select("api", "page_id")


@query("SELECT event_id FROM events WHERE value >= 10 AND event_type NOT IN ('error', 'signup')")
def s10_reddit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_self"), (F.col("event_type") == "signup").alias("stickied"))
    return FE.reddit_posts(rows).select("event_id")


@query(rf"WITH {S.ARTICLES}, w AS (SELECT lower(unnest({S.words('title')})) AS w FROM art) SELECT w AS word, count(*) AS n FROM w WHERE w IN ({', '.join(repr(x) for ws in CORPUS_TAXONOMY.values() for x in ws)}) GROUP BY w ORDER BY n DESC, w LIMIT 15")
def s11_trending(spark, sf_dir):
    from newslake.functions import text as T

    w = articles(spark, sf_dir).select(F.explode(T.words(F.col("title"))).alias("word"))
    return w.filter(F.col("word").isin(*(x for ws in CORPUS_TAXONOMY.values() for x in ws))).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("SELECT page_id AS map_id, 'page' AS kind, url FROM pages UNION ALL SELECT page_id, 'sitemap', 'https://m.example.com/' || page_id FROM pages")
def s12_sitemap(spark, sf_dir):
    """S12 over every page, with the addresses written as XML text."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return _sitemap(table(spark, sf_dir, "pages").withColumn("url", escaped))


def _sitemap(p):
    made = p.select(F.col("page_id").alias("map_id"), F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url><sitemap><loc>https://m.example.com/"), F.col("page_id").cast("string"), F.lit("</loc></sitemap></urlset>")).alias("xml"))
    return FE.sitemap_urls(made)


@query("WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS a, l_orderkey // 2 AS b FROM lineitem WHERE l_orderkey > 1), c AS (SELECT b, a FROM l), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT c.a, r.depth + 1 FROM r JOIN c ON c.b = r.node WHERE r.depth < 4) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def s13_crawl(spark, sf_dir):
    """Breadth-first search by frontier joins over a table of links."""
    l = table(spark, sf_dir, "lineitem").filter("l_orderkey > 1").select(F.floor(F.col("l_orderkey") / 2).cast("bigint").alias("a"), F.col("l_orderkey").alias("b")).distinct()
    return graph.crawl(l, spark.range(1, 2).withColumnRenamed("id", "node"), 4)


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS tier, CASE WHEN doc_id % 2 = 0 THEN 'z_github' ELSE 'z_rss' END AS collector FROM documents")
def s14_adapters(spark, sf_dir):
    i = F.col("doc_id") % 6
    raw = F.when(i == 0, "premium").when(i == 1, "2").when(i == 2, "tier_4").when(i == 3, "nonsense").when(i == 4, "9")
    return table(spark, sf_dir, "documents").select("doc_id", A.tier(raw).alias("tier"), A.collector(F.when(F.col("doc_id") % 2 == 0, "GitHub").otherwise("unheard")).alias("collector"))


@query("SELECT event_type AS region, count(*) AS priority, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS weight FROM events GROUP BY event_type")
def s19_rotation(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region")).agg(F.count("*").alias("priority"))
    return FE.rotation_weights(g).select("region", "priority", F.round("weight", 6).alias("weight"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a.example.com/x y' ELSE 'https://n.example.com/' || page_id END AS url, CASE WHEN page_id % 3 = 0 THEN 'A - b' WHEN page_id % 3 = 1 THEN 'A' ELSE 'Plain' END AS title, CASE WHEN page_id % 3 = 2 THEN '' ELSE 'The Source' END AS source FROM pages")
def s20_google(spark, sf_dir):
    i = F.col("page_id") % 3
    title = F.when(i == 0, "A - b - The Source").when(i == 1, "A - The Source").otherwise("Plain")
    link = F.when(F.col("page_id") % 2 == 0, "https://g.example.com/r?x=1&url=https%3A%2F%2Fa.example.com%2Fx+y").otherwise(F.concat(F.lit("https://n.example.com/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", *(v.alias(k) for k, v in FE.google_entry(title, link).items()))


@query("SELECT page_id, 'T' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Paper' ELSE 'Bing' END AS source, CASE WHEN page_id % 2 = 0 THEN 'i.png' END AS image_url FROM pages")
def s21_bing(spark, sf_dir):
    body = F.when(F.col("page_id") % 2 == 0, F.lit(',"provider":[{"name":"Paper"}],"image":{"thumbnail":{"contentUrl":"i.png"}}')).otherwise("")
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('{"name":"T'), F.col("page_id").cast("string"), F.lit('"'), body, F.lit("}")).alias("json"))
    return FE.bing_articles(made).select("page_id", "title", "source", "image_url")


@query()
def h1_html_text(spark, sf_dir):
    return M.html_texts(table(spark, sf_dir, "pages"))


@query(r'''SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')) AS title, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages''')
def h3_meta(spark, sf_dir):
    m = M.meta_columns(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", m["title"].alias("title"), m["lang"].alias("lang"))


@query(rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages),
t AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(trim(href), '[?#].*$', '') AS target, anchor FROM l WHERE NOT regexp_matches(href, '{M.SKIPPED}') AND href <> ''), g AS (SELECT page_id, target, arg_max(anchor, length(anchor)) AS anchor FROM t GROUP BY page_id, target)
SELECT page_id, count(*) AS n, count(*) FILTER (regexp_matches(target, '{M.ARTICLE}')) AS articles FROM g GROUP BY page_id""")
def h4_links(spark, sf_dir):
    return M.scored_links(M.html_links(table(spark, sf_dir, "pages"))).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("article").alias("articles"))


@query(rf"WITH t AS (SELECT page_id, lower(html) AS h FROM pages) SELECT page_id, round(least(1.0, 0.05 * ({' + '.join(f"CASE WHEN contains(h, '{w}') THEN 1 ELSE 0 END" for w in ('thon', 'ther', 'tion', 'erin', 'thble'))})), 6)::DOUBLE AS tech_score FROM t")
def h6_page_score(spark, sf_dir):
    from functools import reduce

    hits = reduce(lambda a, b: a + b, (F.lower("html").contains(w).cast("int") for w in ("thon", "ther", "tion", "erin", "thble")))
    return table(spark, sf_dir, "pages").select("page_id", F.round(F.least(F.lit(1.0), 0.05 * hits), 6).cast("double").alias("tech_score"))


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r12_stream_windows(spark, sf_dir):
    counts = jobs.available(jobs.window_counts(jobs.file_stream(spark, sf_dir, "events")), "complete")
    return counts.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def r1_stream_dedup(spark, sf_dir):
    keys = ["user_id", "event_type"]
    return jobs.available(jobs.idempotent(jobs.file_stream(spark, sf_dir, "events").select("user_id", "event_type", "ts"), keys, "60 days"), "append").select(*keys)


@query()
def r7_stream_health(spark, sf_dir):
    return jobs.available(jobs.health(A.event_attempts(jobs.file_stream(spark, sf_dir, "events"))), "append")

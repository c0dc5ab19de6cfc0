"""Queries of duplicates, event clustering, scoring and personalisation (sections 2.5 and 2.10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import text as T
from newslake.functions import url as U
from newslake.lexicons import CORPUS_NEGATIVE, CORPUS_POSITIVE, CORPUS_WEIGHTS
from newslake.lake import scratch_dir
from newslake.operators import dedup as X
from newslake.operators.bloom import Bloom
from newslake.operators.stories import EventStore, TitleIndex
from newslake.plans import sql as S
from newslake.plans.registry import q, query
from newslake.plans.scalars import NOW, _sent, articles, joined, now
from newslake.sources.adapters import page_observations, table

_SET = rf"list_sort(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))))"


@query(rf"""WITH {S.ARTICLES}, w AS (SELECT doc_id, {S.words('title')} AS w FROM art), s AS (SELECT doc_id, {_SET} AS s FROM w WHERE len(w) > 0), h AS (SELECT min(doc_id) AS id, s FROM s GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS m FROM h), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.m = b.m AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(k / (na + nb - k), 6) AS sim FROM c WHERE k / (na + nb - k) >= 0.7 - 1e-12""")
def j6_near_dup_pairs(spark, sf_dir):
    """Pairs of different titles with a Jaccard of 0.70 and more."""
    own = X.classes(articles(spark, sf_dir), "doc_id", "title")
    pairs = X.similar_pairs(own.filter(F.col("id") == F.col("class")).select("id", "set"), 0.70)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def d1_greedy_dedup(spark, sf_dir):
    return X.greedy(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title"))


@query()
def d3_minhash_pairs(spark, sf_dir):
    rows = articles(spark, sf_dir).filter(F.length("clean_text") >= 50).select(F.col("doc_id").alias("id"), T.words(F.col("clean_text")).alias("words"))
    return X.minhash_pairs(rows).select("a", "b", F.round("estimate", 4).alias("estimate"))


@query(rf"WITH {S.ARTICLES}, s AS (SELECT doc_id, {S.words('title')} AS w FROM art), f AS (SELECT *, row_number() OVER (PARTITION BY list_sort(list_distinct(w)) ORDER BY doc_id) AS k FROM s) SELECT doc_id FROM f WHERE k = 1")
def d6_token_set(spark, sf_dir):
    """D6 at a Jaccard of one: the first of equal word sets."""
    a = articles(spark, sf_dir)
    return X.first_wins(a, [F.array_join(F.array_sort(F.array_distinct(T.words(F.col("title")))), " ")], ["doc_id"]).select("doc_id")


@query()
def d6_token_set_near(spark, sf_dir):
    """In order of id, titles whose word set has no accepted earlier one at a Jaccard of 0.85 or more."""
    rows = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title")
    found = X.greedy(rows, threshold=0.85, members=lambda title: F.array_distinct(T.words(title)))
    return found.filter("accepted").select(F.col("id").alias("doc_id"))


@query(f"WITH {S.PAGES}, f AS (SELECT page_id, row_number() OVER (PARTITION BY {S.canonical('url')} ORDER BY observed_at, page_id) AS k FROM obs) SELECT page_id FROM f WHERE k = 1")
def d7_exact_url(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    return X.first_wins(o, [U.canonical_url(F.col("url"))], ["observed_at", "page_id"]).select("page_id")


@query(f"WITH {S.PAGES}, u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM obs), t AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(raw_title) > 20 THEN lower(raw_title) ELSE 'id ' || page_id END ORDER BY page_id) AS j FROM u WHERE k = 1) SELECT page_id FROM t WHERE j = 1")
def d8_url_and_title(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    return X.first_wins(o, [F.col("url"), F.when(F.length("title") > 20, F.lower("title"))], ["page_id"]).select("page_id")


@query()
def d9_bloom(spark, sf_dir):
    """A filter merged from two halves of the addresses: what it misses, finds wrongly, holds and weighs."""
    urls = page_observations(table(spark, sf_dir, "pages")).select("url").distinct()
    n = urls.count()
    held = urls.filter(F.crc32("url") % 2 == 0)
    made = Bloom.of(held.filter(F.crc32("url") % 4 == 0), "url", n, 0.001).merged(Bloom.of(held.filter(F.crc32("url") % 4 != 0), "url", n, 0.001))
    hit, own = made.held(urls, "url"), F.crc32("url") % 2 == 0
    fill = made.fill().select("fill", "expected_false_share", "bytes")
    out = hit.agg(F.count_if(own & ~F.col("maybe")).alias("missed"), (F.count_if(~own & F.col("maybe")) / F.greatest(F.count_if(~own), F.lit(1))).alias("false_share"), F.lit(made.m).alias("bits"), F.lit(made.k).alias("hashes"))
    return out.crossJoin(F.broadcast(fill))  # one row each


@query()
def d3_three_tiers(spark, sf_dir):
    """D3: address, title and content of pages against accepted earlier ones."""
    o = page_observations(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("id"), U.canonical_url(F.col("url")).alias("url"), "title", F.col("summary").alias("body"))
    return X.three_tiers(o)


@query()
def d4_minhash_gate(spark, sf_dir):
    """Whole texts through the gate of signatures."""
    return X.minhash_gate(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), T.words(F.col("clean_text")).alias("words")))


@query()
def d5_edit_dedup(spark, sf_dir):
    """Newest first, titles of like length and a ratio above 0.85 go."""
    found = X.edit_dedup(articles(spark, sf_dir).select((-F.col("doc_id")).alias("id"), "title"))
    return found.select((-F.col("id")).alias("doc_id"), "accepted", (-F.col("matched_id")).alias("matched_id"), "similarity")


@query("WITH e AS (SELECT doc_id AS id, md5(text) AS key, doc_id % 5 <> 0 AS passed, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS accepted FROM documents), k AS (SELECT id, key FROM e WHERE passed AND accepted ORDER BY id DESC LIMIT 100) SELECT id, key FROM k")
def d2_commit(spark, sf_dir):
    """What passed and was accepted goes into the index, twice over without effect; the newest hundred stay."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("id")) == 1
    e = d.withColumns({"passed": F.col("id") % 5 != 0, "accepted": first, "at": F.col("id")})
    index = X.committed(e.filter("false").select("id", "key", "at"), e, 100)
    return X.committed(index, e, 100).select("id", "key")


@query("WITH f AS (SELECT doc_id, row_number() OVER (PARTITION BY substring(md5(text), 1, 16) ORDER BY doc_id) AS k, substring(md5(text), 1, 16) AS h FROM documents) SELECT doc_id, h AS content_hash FROM f WHERE k = 1")
def d11_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("content_hash", F.substring(F.md5("text"), 1, 16))
    return X.first_wins(d, [F.col("content_hash")], ["doc_id"]).select("doc_id", "content_hash")


@query("WITH f AS (SELECT doc_id, length(text) AS n, substring(text, 1, 200) || right(text, 200) AS key FROM documents WHERE length(text) > 200) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS kept_chars FROM (SELECT key, max(n) AS n FROM f GROUP BY key)")
def d12_fragments(spark, sf_dir):
    """Fragments with the same ends: the longest stays."""
    f = table(spark, sf_dir, "documents").filter(F.length("text") > 200).select(F.length("text").alias("n"), F.concat(F.substring("text", 1, 200), F.expr("right(text, 200)")).alias("key"))
    return f.groupBy("key").agg(F.max("n").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").cast("bigint").alias("kept_chars"))


@query(rf"WITH {S.ARTICLES}, p AS (SELECT a.doc_id, lower(a.title) AS x, lower(b.title) AS y FROM art a JOIN art b ON b.doc_id = a.doc_id + 1), s AS (SELECT doc_id, CASE WHEN contains(x, y) OR contains(y, x) THEN 1.0 ELSE len(list_filter(string_split(x, ''), lambda c: contains(y, c))) * 1.0 / greatest(length(x), length(y), 1) END AS s FROM p WHERE length(x) > 0 AND length(y) > 0) SELECT doc_id, round(s, 6) AS overlap, s > 0.75 AS similar FROM s")
def d13_overlap(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", F.lower("title").alias("x"))
    p = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id").filter("length(x) > 0 AND length(y) > 0")
    shared = F.size(F.filter(F.split("x", ""), lambda c: F.contains(F.col("y"), c)))
    s = F.when(F.contains("x", F.col("y")) | F.contains("y", F.col("x")), 1.0).otherwise(shared / F.greatest(F.length("x"), F.length("y"), F.lit(1)))
    return p.select("doc_id", F.round(s, 6).alias("overlap"), (s > 0.75).alias("similar"))


@query(f"WITH {S.PAGES}, s AS (SELECT page_id, source_id, CASE WHEN published_at IS NOT NULL THEN 10 ELSE 0 END + least(length(raw_summary) / 100, 10) + CASE WHEN source_id LIKE '%.net' THEN 20 ELSE 0 END AS score FROM obs), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 6) DESC, page_id) AS k FROM s) SELECT source_id, page_id, round(score, 6) AS score FROM r WHERE k = 1")
def a23_best_version(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    score = F.round(F.when(F.col("published_at_hint").isNotNull(), 10).otherwise(0) + F.least(F.length("summary") / 100, F.lit(10)) + F.when(F.col("source_id").endswith(".net"), 20).otherwise(0), 6)
    return X.best_version(o, F.col("source_id"), score, "page_id").select("source_id", "page_id", score.cast("double").alias("score"))


@query()
def c1_event_clusters(spark, sf_dir):
    return X.clusters(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "tags", "discovered_at"))


def _thirds(rows, column):
    """``rows`` in three batches that follow each other by ``column``."""
    span = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if span.low is None:
        return [rows]
    cuts = [span.low + (span.high - span.low) * k // 3 for k in (1, 2)]
    return [rows.filter(F.col(column) <= cuts[0]), rows.filter((F.col(column) > cuts[0]) & (F.col(column) <= cuts[1])), rows.filter(F.col(column) > cuts[1])]


@query()
def c1_event_store(spark, sf_dir):
    """All articles in three batches through the kept events; as ``c1_event_clusters`` over all at once."""
    store = EventStore(spark, scratch_dir(spark))
    for batch in _thirds(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "tags", "discovered_at"), "id"):
        store.add(batch)
    return store.members().drop("at")


@query()
def j7_title_index(spark, sf_dir):
    """All titles in three batches through the kept index, without a cap; as ``d1_greedy_dedup`` over all at once."""
    index = TitleIndex(spark, scratch_dir(spark), cap=None)
    told = [index.add(batch) for batch in _thirds(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title"), "id")]
    return reduce(DataFrame.unionByName, told)


def evidence(spark, sf_dir):
    """Deterministic evidence: articles of a tenth of the ids are one event."""
    a = articles(spark, sf_dir)
    return a.select((F.col("doc_id") % 100).alias("event_id"), "source_name", "source_tier", (F.col("source_tier") == 1).alias("is_primary"), "discovered_at", F.col("doc_id").alias("article_id"), "title")


_EV = f"""{S.ARTICLES}, ev AS (SELECT doc_id % 100 AS event_id, lower(trim(source_name)) AS name, source_tier, source_tier = 1 AS is_primary, discovered_at, doc_id, title FROM art),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, name ORDER BY discovered_at, doc_id) = 1 AS fresh, row_number() OVER (PARTITION BY event_id ORDER BY discovered_at, doc_id) = 1 AS opening FROM ev),
g AS (SELECT event_id, min(source_tier) AS best, bool_or(is_primary) AS prim, sum(CASE WHEN fresh AND NOT opening THEN CASE WHEN source_tier <= 2 THEN 0.15::DOUBLE WHEN source_tier = 3 THEN 0.05::DOUBLE ELSE 0.0 END ELSE 0.0 END) AS extra, count(*) AS n_sources, min(discovered_at) AS first_seen, arg_min(title, doc_id) AS headline FROM k GROUP BY event_id),
f AS (SELECT *, round(least(1.0, CASE best WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 ELSE 0.15 END + CASE WHEN prim THEN 0.05 ELSE 0.0 END + least(0.3, extra)), 3) AS confidence FROM g)"""


@query(f"WITH {_EV} SELECT event_id, CAST(confidence AS DOUBLE) AS confidence, n_sources FROM f")
def c3_confidence(spark, sf_dir):
    return X.confidence(evidence(spark, sf_dir)).select("event_id", "confidence", "n_sources")


@query(f"WITH {_EV} SELECT event_id, CAST(round(greatest(0.2, least(1.0, 1.0 - greatest(n_sources - 1, 0) * 0.15::DOUBLE - greatest(n_sources % 5 - 1, 0) * 0.05::DOUBLE)), 3) AS DOUBLE) AS novelty FROM f")
def c5_novelty(spark, sf_dir):
    g = X.confidence(evidence(spark, sf_dir))
    return g.select("event_id", X.novelty(F.col("n_sources"), F.col("n_sources") % 5).alias("novelty"))


_EAGE = S.minutes("first_seen", "TIMESTAMP '2024-01-01 02:00:00'")


@query(f"WITH {_EV}, a AS (SELECT event_id, confidence, greatest({_EAGE}, 0.0) AS age, event_id % 2 = 0 AS hot FROM f), s AS (SELECT *, {S.level('age')} AS freshness, CASE WHEN age <= 5 THEN 1.0 WHEN age <= 30 THEN 0.9 WHEN age <= 120 THEN 0.75 WHEN age <= 360 THEN 0.5 WHEN age <= 1440 THEN 0.3 WHEN age <= 4320 THEN 0.1 ELSE 0.0 END AS score FROM a) SELECT event_id, freshness, CAST(score AS DOUBLE) AS freshness_score, freshness = 'breaking' AND confidence >= 0.7 AND hot AS is_breaking FROM s")
def c6_event_freshness(spark, sf_dir):
    """Freshness of an event and whether it is breaking."""
    g = X.confidence(evidence(spark, sf_dir)).withColumn("age", F.greatest(D.minutes_between(F.col("first_seen"), F.lit("2024-01-01 02:00:00").cast("timestamp")), F.lit(0.0)))
    importance = F.when(F.col("event_id") % 2 == 0, 0.75).otherwise(0.5)
    return g.select("event_id", D.level(F.col("age")).alias("freshness"), D.step_score(F.col("age")).alias("freshness_score"), ((D.level(F.col("age")) == "breaking") & (F.col("confidence") >= 0.70) & (importance >= 0.60)).alias("is_breaking"))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN n_sources <= 1 THEN 'event_detected' ELSE 'event_updated' END AS event_type, CASE WHEN confidence >= 0.9 THEN 1 ELSE 2 END AS priority, 'pub:' || event_id || ':' || CAST(epoch(first_seen) AS BIGINT) AS idempotency_key FROM f")
def r2_publications(spark, sf_dir):
    """R2: one envelope an event."""
    g = X.confidence(evidence(spark, sf_dir))
    return g.select("event_id", F.when(F.col("n_sources") <= 1, "event_detected").otherwise("event_updated").alias("event_type"), F.when(F.col("confidence") >= 0.9, 1).otherwise(2).alias("priority"), F.concat(F.lit("pub:"), F.col("event_id").cast("string"), F.lit(":"), F.unix_timestamp("first_seen").cast("string")).alias("idempotency_key"))


PREFS = [(1, "ther", 0.9, "thon", "src1", 0.8), (2, "attion", 0.5, "erin", "src2", 0.4), (3, "thble", 0.7, "anea", "src3", 1.0)]


@query(f"WITH {S.ARTICLES}, p(user_id, topic, weight, company, source, trust) AS (VALUES {', '.join(map(str, PREFS))}), s AS (SELECT user_id, doc_id, 0.4 * CASE WHEN contains(lower(clean_text), topic) THEN weight ELSE 0.0 END + 0.3 * CASE WHEN contains(lower(clean_text), company) THEN 1.0 ELSE 0.0 END + 0.15 * CASE WHEN source_name = source THEN trust ELSE 0.0 END + 0.15 * greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-01-02') - epoch_us(discovered_at)) / 3.6e9 / 48) AS score FROM art, p), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM s) SELECT user_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, k AS rank FROM r WHERE k <= 10")
def c8_personal_score(spark, sf_dir):
    """Topics, companies, sources and recency for each user of a short broadcast list; the best ten."""
    p = spark.createDataFrame(PREFS, "user_id int, topic string, weight double, company string, source string, trust double")
    a = articles(spark, sf_dir).select("doc_id", F.lower("clean_text").alias("t"), "source_name", "discovered_at")
    rows = a.join(F.broadcast(p), F.lit(True))
    recency = F.greatest(F.lit(0.0), 1 - (F.lit(1704153600) - F.unix_timestamp("discovered_at")) / 3600 / 48)
    score = 0.4 * F.when(F.contains("t", F.col("topic")), F.col("weight")).otherwise(0.0) + 0.3 * F.when(F.contains("t", F.col("company")), 1.0).otherwise(0.0) + 0.15 * F.when(F.col("source_name") == F.col("source"), F.col("trust")).otherwise(0.0) + 0.15 * recency
    ranked = rows.select("user_id", "doc_id", F.round(score, 6).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "doc_id")).cast("bigint")).filter("rank <= 10")


_DIS = " + ".join(f"CASE WHEN {S.has('lower(clean_text)', w)} THEN {v}::DOUBLE ELSE 0.0 END" for w, v in CORPUS_WEIGHTS.items())


@query(f"WITH {S.ARTICLES}, s AS (SELECT doc_id, ({_DIS}) / 10 AS d, {_sent} AS x FROM art) SELECT doc_id, round(d, 6) AS disruption, d > 0.4 AND abs(x) > 0.3 AS disruptive, round(least(2 * d + abs(x), 1.0), 6) AS criticality FROM s")
def c11_disruption(spark, sf_dir):
    from functools import reduce

    t = F.lower("clean_text")
    d = reduce(lambda a, b: a + b, (F.when(T.present(t, w), v).otherwise(0.0) for w, v in CORPUS_WEIGHTS.items())) / 10
    x = T.sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE)
    return articles(spark, sf_dir).select("doc_id", F.round(d, 6).alias("disruption"), ((d > 0.4) & (F.abs(x) > 0.3)).alias("disruptive"), F.round(F.least(2 * d + F.abs(x), F.lit(1.0)), 6).alias("criticality"))


@query("SELECT event_id, CASE WHEN value >= 300 THEN 'critical' WHEN value >= 150 THEN 'high' WHEN value >= 75 THEN 'medium' END AS level, value >= 150 AS external, CASE WHEN value >= 300 THEN 'slack|email|log' WHEN value >= 150 THEN 'slack|log' ELSE 'log' END AS channels FROM events WHERE value >= 75")
def c9_alerts(spark, sf_dir):
    """Criticality levels and channels; the hourly limit is ``w4_alert_limit``."""
    v = F.col("value")
    return table(spark, sf_dir, "events").filter(v >= 75).select("event_id", F.when(v >= 300, "critical").when(v >= 150, "high").otherwise("medium").alias("level"), (v >= 150).alias("external"), F.when(v >= 300, "slack|email|log").when(v >= 150, "slack|log").otherwise("log").alias("channels"))


@query(f"WITH {S.ARTICLES}, s AS (SELECT doc_id, source_name, doc_id % 10 AS criticality, doc_id % 7 = 0 AS disruptive FROM art) SELECT doc_id FROM s WHERE criticality >= 8 OR disruptive ORDER BY criticality DESC, doc_id LIMIT 40")
def o11_priority_list(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("c", F.col("doc_id") % 10)
    return a.filter((F.col("c") >= 8) | (F.col("doc_id") % 7 == 0)).orderBy(F.desc("c"), "doc_id").limit(40).select("doc_id")


def disruption_schema():
    """What a pluggable analyst returns; the call itself is outside the engine."""
    return "score double, category string, impact string, affected array<string>, reasoning string"


@query(f"WITH {S.ARTICLES} SELECT doc_id, CAST(length(title) % 10 AS DOUBLE) / 10 AS score, CASE WHEN length(title) % 10 >= 5 THEN 'high' ELSE 'low' END AS impact FROM art")
def c10_analyst(spark, sf_dir):
    """A stand-in analyst behind the pluggable schema."""
    n = F.length("title") % 10
    made = F.to_json(F.struct((n / 10).alias("score"), F.when(n >= 5, "high").otherwise("low").alias("impact")))
    return articles(spark, sf_dir).select("doc_id", F.from_json(made, disruption_schema()).alias("a")).select("doc_id", "a.score", "a.impact")

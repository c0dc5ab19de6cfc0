"""Queries of aggregations, sorts, windows and joins (sections 2.3, 2.4 and 2.6 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.functions import url as U
from newslake.lexicons import CORPUS_NEGATIVE, CORPUS_POSITIVE, CORPUS_STOP, CORPUS_TAXONOMY
from newslake.operators.folds import clamped_walks
from newslake.operators.quantiles import at_ranks
from newslake.plans import sql as S
from newslake.plans.registry import q, query
from newslake.plans.scalars import _label, _sent, articles, joined
from newslake.sources.adapters import event_attempts, page_observations, table


def attempts(spark, sf_dir):
    return event_attempts(table(spark, sf_dir, "events"))


@query(f"WITH {S.ATTEMPTS} SELECT count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (status_code = 404) AS gone, count(*) FILTER (status_code = 429) AS limited, count(DISTINCT source_id) AS sources FROM att")
def a1_store_stats(spark, sf_dir):
    return attempts(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(F.col("status_code") == 404).alias("gone"), F.count_if(F.col("status_code") == 429).alias("limited"), F.countDistinct("source_id").alias("sources"))


@query("SELECT 'status' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2")
def a1_by_status_and_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sets = e.groupingSets([[F.col("event_type")], [F.col("day")]], F.col("event_type"), F.col("day")).agg(F.count("*").alias("n"), F.grouping("day").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "status").otherwise("day").alias("kind"), F.coalesce("event_type", "day").alias("name"), "n")


@query("WITH r AS (SELECT CASE WHEN length(text) < 400 THEN 'short' WHEN regexp_matches(text, '[!?]{2,}') THEN 'clickbait' WHEN contains(text, '|') THEN 'table' ELSE 'ok' END AS reason FROM documents) SELECT reason, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def a2_rejections(spark, sf_dir):
    reason = F.when(F.length("text") < 400, "short").when(F.col("text").rlike("[!?]{2,}"), "clickbait").when(F.col("text").contains("|"), "table").otherwise("ok")
    n = table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), "reason").limit(10)


@query("SELECT count(*) AS n FROM documents")
def a3_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


@query(rf"WITH {S.ARTICLES}, l AS (SELECT title FROM art ORDER BY discovered_at DESC, doc_id DESC LIMIT 200), w AS (SELECT unnest({S.words('title')}) AS word FROM l) SELECT word, count(*) AS n FROM w WHERE length(word) > 3 AND NOT list_contains({S.literal_list(CORPUS_STOP)}, word) GROUP BY word ORDER BY n DESC, word LIMIT 10")
def a4_trending_words(spark, sf_dir):
    latest = articles(spark, sf_dir).orderBy(F.desc("discovered_at"), F.desc("doc_id")).limit(200)
    w = latest.select(F.explode(T.words(F.col("title"))).alias("word")).filter((F.length("word") > 3) & ~F.col("word").isin(*CORPUS_STOP))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


_TOPIC = "CASE " + " ".join(f"WHEN {' OR '.join(S.has('lower(clean_text)', w) for w in ws)} THEN {q(c)}" for c, ws in CORPUS_TAXONOMY.items()) + " ELSE 'General' END"


def topic(text: F.Column) -> F.Column:
    """A5: the first category in order that has a word in ``text``."""
    hit = lambda ws: reduce(lambda a, b: a | b, (T.present(text, w) for w in ws))
    first, *rest = CORPUS_TAXONOMY.items()
    return reduce(lambda w, c: w.when(hit(c[1]), c[0]), rest, F.when(hit(first[1]), first[0])).otherwise("General")


@query(f"WITH {S.ARTICLES} SELECT topic, count(*) AS n, count(DISTINCT source_name) AS sources, min(doc_id) AS first_doc FROM (SELECT doc_id, source_name, {_TOPIC} AS topic FROM art) GROUP BY topic")
def a5_topics(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", "source_name", topic(F.lower("clean_text")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("sources"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {S.ARTICLES}, u AS (SELECT *, row_number() OVER (PARTITION BY md5(clean_text) ORDER BY doc_id) AS k FROM art), r AS (SELECT * FROM u WHERE k = 1 AND discovered_at >= TIMESTAMP '2024-01-01 06:00:00' ORDER BY discovered_at DESC, doc_id LIMIT 100) SELECT doc_id, {_TOPIC} AS topic FROM r")
def a6_feed_document(spark, sf_dir):
    unique = articles(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy(F.md5("clean_text")).orderBy("doc_id"))).filter("k = 1")
    recent = unique.filter(F.col("discovered_at") >= F.lit("2024-01-01 06:00:00").cast("timestamp")).orderBy(F.desc("discovered_at"), "doc_id").limit(100)
    return recent.select("doc_id", topic(F.lower("clean_text")).alias("topic"))


@query(f"WITH {S.ATTEMPTS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS total, count(*) FILTER (success) AS ok, round(100.0 * count(*) FILTER (success) / count(*), 4) AS success_pct, round(avg(response_time_ms), 4) AS avg_ms FROM att GROUP BY 1")
def a7_scrape_hourly(spark, sf_dir):
    a = attempts(spark, sf_dir).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00").alias("hour"))
    return a.agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.round(100.0 * F.count_if("success") / F.count("*"), 4).alias("success_pct"), F.round(F.avg("response_time_ms"), 4).alias("avg_ms"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY 1")
def a7_by_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.sum(F.length("html")).cast("bigint").alias("n_chars"))


@query("SELECT event_type AS technique, NULL AS platform, count(*) AS attempts, round(avg(value), 4) AS avg_ms FROM events GROUP BY event_type UNION ALL SELECT NULL, CAST(user_id % 5 AS BIGINT), count(*), round(avg(value), 4) FROM events GROUP BY user_id % 5")
def a8_attempt_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("technique"), (F.col("user_id") % 5).alias("platform"), "value")
    return e.groupingSets([[F.col("technique")], [F.col("platform")]], F.col("technique"), F.col("platform")).agg(F.count("*").alias("attempts"), F.round(F.avg("value"), 4).alias("avg_ms"))


def health_window(rows):
    """The last 100 attempts of each source: success rate, mean time, failures at the end, status."""
    late = Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = rows.withColumn("k", F.row_number().over(late)).filter("k <= 100")
    last = last.withColumn("since", F.count_if("success").over(late.rowsBetween(Window.unboundedPreceding, 0)))
    out = last.groupBy("source_id").agg(F.count("*").alias("checks"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg("response_time_ms"), 4).alias("avg_ms"), F.count_if(F.col("since") == 0).alias("failures"), F.max_by(F.when(~F.col("success"), F.col("status_code")), F.when(~F.col("success"), -F.col("k"))).cast("bigint").alias("last_error"))
    status = F.when((F.col("success_rate") < 0.3) | (F.col("failures") >= 5), "unhealthy").when(F.col("success_rate") < 0.7, "degraded").otherwise("healthy")
    return out.withColumn("status", status)


@query(f"""WITH {S.ATTEMPTS}, k AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (success) OVER (w ROWS UNBOUNDED PRECEDING) AS since FROM att WINDOW w AS (PARTITION BY source_id ORDER BY ts DESC, event_id DESC)),
g AS (SELECT source_id, count(*) AS checks, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(response_time_ms), 4) AS avg_ms, count(*) FILTER (since = 0) AS failures, CAST(arg_min(status_code, rn) FILTER (NOT success) AS BIGINT) AS last_error FROM k WHERE rn <= 100 GROUP BY source_id)
SELECT *, CASE WHEN success_rate < 0.3 OR failures >= 5 THEN 'unhealthy' WHEN success_rate < 0.7 THEN 'degraded' ELSE 'healthy' END AS status FROM g""")
def a9_health_window(spark, sf_dir):
    return health_window(attempts(spark, sf_dir))


@query(f"WITH {S.ARTICLES}, s AS (SELECT {_TOPIC} AS topic, {_sent} AS x FROM art) SELECT topic, count(*) AS n, round(count(*) FILTER (x >= 0.15) * 1.0 / count(*), 6) AS positive, round(count(*) FILTER (x <= -0.15) * 1.0 / count(*), 6) AS negative FROM s GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def a10_digest(spark, sf_dir):
    s = articles(spark, sf_dir).select(topic(F.lower("clean_text")).alias("topic"), T.sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE).alias("x"))
    return s.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("x") >= 0.15) / F.count("*"), 6).alias("positive"), F.round(F.count_if(F.col("x") <= -0.15) / F.count("*"), 6).alias("negative")).orderBy(F.desc("n"), "topic").limit(5)


@query(f"WITH {S.ARTICLES}, s AS (SELECT source_name, doc_id, {_sent} AS x, row_number() OVER (PARTITION BY source_name ORDER BY doc_id DESC) AS k, count(*) OVER (PARTITION BY source_name) AS n FROM art) SELECT source_name, round(avg(x), 6) AS overall, round(avg(x) FILTER (k <= greatest(1, n // 3)), 6) AS newest_third FROM s GROUP BY source_name")
def a11_sentiment_panel(spark, sf_dir):
    """Mean sentiment of a source and of its newest third."""
    s = articles(spark, sf_dir).select("source_name", "doc_id", T.sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE).alias("x"))
    own = Window.partitionBy("source_name")
    s = s.withColumn("k", F.row_number().over(own.orderBy(F.desc("doc_id")))).withColumn("n", F.count("*").over(own))
    return s.groupBy("source_name").agg(F.round(F.avg("x"), 6).alias("overall"), F.round(F.avg(F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3)), F.col("x"))), 6).alias("newest_third"))


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, max(value) AS most, min(value) AS least, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def a12_quality_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    middle = at_ranks(e, "event_type", "value", {"upper_median": 0.5})
    return e.groupBy("event_type").agg(F.max("value").alias("most"), F.min("value").alias("least"), F.round(F.avg("value"), 4).alias("mean")).join(middle, "event_type")


BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500]


@query("SELECT event_type, b AS le, count(*) FILTER (value <= b) AS n, round(sum(value), 2) AS total, count(*) AS count FROM events, (VALUES " + ", ".join(f"({b})" for b in BOUNDS) + ") t(b) GROUP BY event_type, b")
def a13_histogram(spark, sf_dir):
    """Cumulative buckets with sum and count, in one pass."""
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array(*(F.count_if(F.col("value") <= b) for b in BOUNDS)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("count"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, BOUNDS)).alias("le"), F.col("n").alias("n")))
    return sums.select("event_type", each.alias("x"), "total", "count").select("event_type", F.col("x.le").alias("le"), F.col("x.n").alias("n"), "total", "count")


@query("WITH t AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS h, value FROM events) SELECT user_id, round(greatest(0, regr_slope(value, h)), 6) AS slope, min(value) AS least, max(value) AS most, round(arg_max(value, h) - arg_min(value, h), 4) AS delta, round(avg(value), 4) AS mean FROM t WHERE h >= 1.0 / 60 GROUP BY user_id HAVING count(*) >= 2")
def a15_ols_slope(spark, sf_dir):
    h = (F.unix_micros("ts") - F.lit(1704067200000000)) / 3.6e9
    t = table(spark, sf_dir, "events").select("user_id", h.alias("h"), "value").filter(F.col("h") >= 1.0 / 60)
    g = t.groupBy("user_id").agg(F.regr_slope("value", "h").alias("s"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.max_by("value", "h") - F.min_by("value", "h"), 4).alias("delta"), F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))
    return g.filter("n >= 2").select("user_id", F.round(F.greatest(F.lit(0.0), "s"), 6).alias("slope"), "least", "most", "delta", "mean")


@query("WITH g AS (SELECT CAST(ts AS DATE) AS d, count(*) AS generated, count(*) FILTER (event_type IN ('view', 'click')) AS persisted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'signup') AS dropped, count(*) FILTER (event_type = 'purchase') AS in_flight FROM events GROUP BY 1) SELECT count(*) AS days, bool_and(generated = persisted + rejected + dropped + in_flight) AS conserved, CAST(sum(generated) AS BIGINT) AS generated FROM g")
def a16_conservation(spark, sf_dir):
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    g = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("generated"), (kind("view", "click") + kind("error") + kind("signup") + kind("purchase")).alias("accounted"))
    return g.agg(F.count("*").alias("days"), F.bool_and(F.col("generated") == F.col("accounted")).alias("conserved"), F.sum("generated").alias("generated"))


@query("WITH m AS (SELECT avg(value) AS mean, max(value) AS most, count(*) FILTER (event_type = 'error') * 1.0 / count(*) AS errors, count(*) AS n FROM events) SELECT slo, passed FROM (SELECT 'mean_under_60' AS slo, mean < 60 AS passed FROM m UNION ALL SELECT 'max_under_400', most < 400 FROM m UNION ALL SELECT 'errors_under_5_pct', errors < 0.05 FROM m UNION ALL SELECT 'volume', n >= 100 FROM m UNION ALL SELECT 'all', mean < 60 AND most < 400 AND errors < 0.05 AND n >= 100 FROM m)")
def a17_slos(spark, sf_dir):
    m = table(spark, sf_dir, "events").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"), F.count("*").alias("n"))
    checks = {"mean_under_60": F.col("mean") < 60, "max_under_400": F.col("most") < 400, "errors_under_5_pct": F.col("errors") < 0.05, "volume": F.col("n") >= 100}
    rows = [F.struct(F.lit(k).alias("slo"), v.alias("passed")) for k, v in checks.items()]
    rows.append(F.struct(F.lit("all").alias("slo"), reduce(lambda a, b: a & b, checks.values()).alias("passed")))
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.slo", "r.passed")


@query("SELECT event_type, list_sort(list(value))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS p50, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95, list_sort(list(value))[least(CAST(floor(count(*) * 0.99) AS BIGINT), count(*) - 1) + 1] AS p99 FROM events GROUP BY event_type")
def a18_percentiles(spark, sf_dir):
    return at_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.50, "p95": 0.95, "p99": 0.99})


@query("SELECT count(*) AS total, count(*) - count(DISTINCT md5(text)) AS duplicates, round((count(*) - count(DISTINCT md5(text))) * 1.0 / count(*), 6) AS rate FROM documents")
def a19_dedup_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("duplicates"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("rate"))


@query("SELECT role, count(*) AS requests, CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(length(text) * CASE role WHEN 'user' THEN 0.001 WHEN 'assistant' THEN 0.002 ELSE 0.0 END), 4) AS cost FROM conversations GROUP BY role")
def a20_usage(spark, sf_dir):
    prices = spark.createDataFrame([("user", 0.001), ("assistant", 0.002)], "role string, price double")
    c = table(spark, sf_dir, "conversations").join(F.broadcast(prices), "role", "left")
    return c.groupBy("role").agg(F.count("*").alias("requests"), F.sum(F.length("text")).cast("bigint").alias("tokens"), F.round(F.sum(F.length("text") * F.coalesce("price", F.lit(0.0))), 4).alias("cost"))


@query(f"WITH {S.ATTEMPTS} SELECT CAST(k % 4 AS BIGINT) AS fix_type, count(*) AS n, round(count(*) FILTER (success) * 1.0 / count(*), 6) AS success_rate FROM att GROUP BY k % 4")
def a21_fix_rates(spark, sf_dir):
    return attempts(spark, sf_dir).groupBy((F.col("k") % 4).alias("fix_type")).agg(F.count("*").alias("n"), F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"))


@query("(SELECT 'source' AS facet, source AS name, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, name LIMIT 20) UNION ALL (SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2)")
def a22_facets(spark, sf_dir):
    top = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(F.count("*").alias("n"))
    return top.select(F.lit("source").alias("facet"), "name", "n").union(days.select(F.lit("day").alias("facet"), "name", "n"))


@query(f"WITH {S.ATTEMPTS} SELECT source_id % 10 AS component, CASE max(CASE WHEN status_code = 500 THEN 2 WHEN NOT success THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM att WHERE ts >= TIMESTAMP '2024-01-30 22:00:00' GROUP BY 1")
def a24_component_health(spark, sf_dir):
    rank = F.when(F.col("status_code") == 500, 2).when(~F.col("success"), 1).otherwise(0)
    a = attempts(spark, sf_dir).filter(F.col("ts") >= F.lit("2024-01-30 22:00:00").cast("timestamp")).groupBy((F.col("source_id") % 10).alias("component")).agg(F.max(rank).alias("r"))
    return a.select("component", F.when(F.col("r") == 2, "unhealthy").when(F.col("r") == 1, "degraded").otherwise("healthy").alias("status"))


@query("SELECT count(*) AS lost, coalesce(min(event_id), -1) AS first_lost FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 97 <> 5)")
def a25_silent_loss(spark, sf_dir):
    """Generated ids that are in no outcome."""
    e = table(spark, sf_dir, "events").select("event_id")
    return e.join(e.filter("event_id % 97 <> 5"), "event_id", "left_anti").agg(F.count("*").alias("lost"), F.coalesce(F.min("event_id"), F.lit(-1)).alias("first_lost"))


@query("SELECT CASE WHEN value / 40 >= 9 THEN 'S' WHEN value / 40 >= 7.5 THEN 'A' WHEN value / 40 >= 6 THEN 'B' ELSE 'C' END AS band, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def a26_bands(spark, sf_dir):
    v = F.col("value") / 40
    band = F.when(v >= 9, "S").when(v >= 7.5, "A").when(v >= 6, "B").otherwise("C")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {S.ATTEMPTS} SELECT status_code, source_id % 20 AS part, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_seen, CAST(epoch(max(ts)) AS BIGINT) AS last_seen FROM att WHERE NOT success GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def a27_warnings(spark, sf_dir):
    a = attempts(spark, sf_dir).filter(~F.col("success")).groupBy("status_code", (F.col("source_id") % 20).alias("part"))
    return a.agg(F.count("*").alias("n"), F.round(F.min(F.unix_micros("ts") / 1e6)).cast("bigint").alias("first_seen"), F.round(F.max(F.unix_micros("ts") / 1e6)).cast("bigint").alias("last_seen")).orderBy(F.desc("n"), "status_code", "part").limit(10)


@query(rf"WITH {S.ARTICLES}, w AS (SELECT doc_id, unnest({S.words('clean_text')}) AS word FROM art), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND NOT list_contains({S.literal_list(CORPUS_STOP)}, word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM c) SELECT doc_id, word, n, k FROM r WHERE k <= 15")
def a28_keywords(spark, sf_dir):
    w = articles(spark, sf_dir).select("doc_id", F.explode(T.words(F.col("clean_text"))).alias("word")).filter((F.length("word") >= 4) & ~F.col("word").isin(*CORPUS_STOP))
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")).cast("bigint")).filter("k <= 15")


@query("SELECT doc_id, source FROM documents WHERE source = 'src7' ORDER BY doc_id DESC LIMIT 20 OFFSET 5")
def o1_recent(spark, sf_dir):
    return recent_articles(articles(spark, sf_dir), 20, 5, "src7").select("doc_id", F.col("source_name").alias("source"))


def recent_articles(rows, limit: int = 50, offset: int = 0, source: str | None = None):
    """O1: newest first, 1 to 500 rows, from one source if given."""
    rows = rows.filter(F.col("source_name") == source) if source else rows
    return rows.orderBy(F.desc("discovered_at"), F.desc("doc_id")).offset(max(0, offset)).limit(min(500, max(1, limit)))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 100")
def o2_events_since(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (F.col("ts") > F.lit("2024-01-20").cast("timestamp"))).orderBy("ts", "event_id").limit(100).select("event_id", "user_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def o3_top(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


@query(f"WITH {S.PAGES} SELECT page_id FROM obs ORDER BY coalesce(published_at, observed_at) DESC, page_id LIMIT 30")
def o4_sorted(spark, sf_dir):
    return page_observations(table(spark, sf_dir, "pages")).orderBy(F.coalesce("published_at_hint", "observed_at").desc(), "page_id").limit(30).select("page_id")


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_type = 'error' DESC, event_id) AS k FROM events) SELECT event_id, CASE WHEN k <= 4 THEN 'top' ELSE 'shortlist' END AS band FROM r WHERE k <= 14")
def o5_selection(spark, sf_dir):
    best = table(spark, sf_dir, "events").orderBy(F.desc("value"), (F.col("event_type") == "error").desc(), "event_id").limit(14)
    k = F.row_number().over(Window.partitionBy().orderBy(F.desc("value"), (F.col("event_type") == "error").desc(), "event_id"))
    return best.select("event_id", F.when(k <= 4, "top").otherwise("shortlist").alias("band"))


@query(f"WITH {S.ATTEMPTS}, g AS (SELECT source_id, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS succ, least(1.0, (epoch_us(TIMESTAMP '2024-01-31') - max(epoch_us(ts))) / 3.6e9 / 24) AS recency, count(*) FILTER (event_type = 'purchase') * 1.0 / count(*) AS yield FROM att GROUP BY source_id) SELECT source_id, round(0.3 * (source_id % 4 + 1) / 4 + 0.2 * (1 - succ) + 0.3 * recency + 0.2 * (1 - yield), 6) AS priority FROM g")
def o6_source_priority(spark, sf_dir):
    a = attempts(spark, sf_dir).groupBy("source_id").agg(F.avg(F.col("success").cast("double")).alias("succ"), F.least(F.lit(1.0), (F.lit(1706659200000000) - F.max(F.unix_micros("ts"))) / 3.6e9 / 24).alias("recency"), (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("yield"))
    return a.select("source_id", F.round(0.3 * (F.col("source_id") % 4 + 1) / 4 + 0.2 * (1 - F.col("succ")) + 0.3 * F.col("recency") + 0.2 * (1 - F.col("yield")), 6).alias("priority"))


@query(f"WITH {S.PAGES}, g AS (SELECT source_id, count(*) AS n, (epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(observed_at))) / 3.6e9 AS h, avg(length(raw_title)) / 100 AS quality FROM obs GROUP BY source_id) SELECT source_id, round(CASE WHEN h <= 1 THEN 0.5 WHEN h <= 6 THEN 0.4 WHEN h <= 24 THEN 0.25 ELSE 0.1 END + CASE WHEN n >= 10 THEN 0.2 WHEN n >= 5 THEN 0.1 ELSE 0.05 END + 0.3 * least(1.0, quality), 6) AS rank_score FROM g")
def o7_discovery_rank(spark, sf_dir):
    g = page_observations(table(spark, sf_dir, "pages")).groupBy("source_id").agg(F.count("*").alias("n"), ((F.lit(1706745600) - F.max(F.unix_timestamp("observed_at"))) / 3600).alias("h"), (F.avg(F.length("title")) / 100).alias("quality"))
    score = F.when(F.col("h") <= 1, 0.5).when(F.col("h") <= 6, 0.4).when(F.col("h") <= 24, 0.25).otherwise(0.1) + F.when(F.col("n") >= 10, 0.2).when(F.col("n") >= 5, 0.1).otherwise(0.05) + 0.3 * F.least(F.lit(1.0), "quality")
    return g.select("source_id", F.round(score, 6).alias("rank_score"))


@query("WITH p AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 21 OFFSET 40) SELECT (SELECT list(doc_id ORDER BY doc_id)[1:20] FROM p)[1] AS first_id, CAST(3 AS INTEGER) AS page, CAST(20 AS INTEGER) AS per_page, (SELECT count(*) FROM documents) AS total, (SELECT count(*) > 20 FROM p) AS has_more")
def o8_page(spark, sf_dir):
    return page_of(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3, 20).select(F.col("items")[0].alias("first_id"), "page", "per_page", "total", "has_more")


def page_of(rows, order: str, page: int, per_page: int):
    """One page of ids with total and whether there is more; 1 to 100 rows a page."""
    per_page = min(100, max(1, per_page))
    own = rows.orderBy(order).offset((max(1, page) - 1) * per_page).limit(per_page + 1).agg(F.sort_array(F.collect_list(order)).alias("ids"))
    return own.crossJoin(rows.agg(F.count("*").alias("total"))).select(F.slice("ids", 1, per_page).alias("items"), F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), "total", (F.size("ids") > per_page).alias("has_more"))


@query(f"WITH {S.PAGES} SELECT page_id FROM obs ORDER BY (observed_at >= TIMESTAMP '2024-01-31 02:00:00') DESC, page_id % 7 = 0 DESC, page_id % 11 DESC, coalesce(published_at, observed_at) DESC, page_id LIMIT 50")
def o9_feed_order(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    return o.orderBy((F.col("observed_at") >= F.lit("2024-01-31 02:00:00").cast("timestamp")).desc(), (F.col("page_id") % 7 == 0).desc(), (F.col("page_id") % 11).desc(), F.coalesce("published_at_hint", "observed_at").desc(), "page_id").limit(50).select("page_id")


@query(f"WITH {S.PAGES}, c AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN substring(md5(url || raw_title), 1, 32) ELSE CAST(page_id AS VARCHAR) END AS id, coalesce(nullif(raw_title, ''), 'Untitled') AS title, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM obs) SELECT page_id, id, title FROM c WHERE k = 1")
def o10_canonical_list(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages")).withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("k = 1")
    made = F.when(F.col("page_id") % 6 == 0, F.md5(F.concat("url", "title"))).otherwise(F.col("page_id").cast("string"))
    return o.select("page_id", made.alias("id"), F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"))


@query("SELECT doc_id FROM documents UNION ALL SELECT page_id FROM pages")
def u1_union(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), allowMissingColumns=True).select("doc_id")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE contains(lower(d.text), 'thon')")
def j1_hits_join(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").filter(F.lower("text").contains("thon")).select("doc_id")
    return hits.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@query(rf"WITH {S.ARTICLES} SELECT DISTINCT doc_id FROM art WHERE list_contains({S.words('title')}, 'tion') OR list_contains({S.words('title')}, 'es') OR lower(lang) = 'es'")
def j2_by_entity(spark, sf_dir):
    names = F.concat(F.col("tags"), T.words(F.col("title")))
    return articles(spark, sf_dir).filter(F.exists(names, lambda x: F.lower(x).isin("tion", "es"))).select("doc_id").distinct()


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n, array_to_string(list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey IS NOT NULL), ',') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j3_hydration(spark, sf_dir):
    """J3 over every order."""
    return _hydrated(spark, sf_dir, table(spark, sf_dir, "orders"))


def _hydrated(spark, sf_dir, orders):
    o = orders.select("o_orderkey")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n"), shown.alias("items"))


@query(f"WITH {S.ATTEMPTS}, h AS (SELECT source_id, max(ts) AS t FROM att WHERE success AND source_id % 3 = 0 GROUP BY source_id) SELECT count(*) AS sources, count(h.source_id) AS hydrated FROM (SELECT DISTINCT source_id FROM att) r LEFT JOIN h USING (source_id)")
def j4_health_hydration(spark, sf_dir):
    a = attempts(spark, sf_dir)
    health = a.filter(F.col("success") & (F.col("source_id") % 3 == 0)).groupBy("source_id").agg(F.max("ts").alias("t"))
    return a.select("source_id").distinct().join(health, "source_id", "left").agg(F.count("*").alias("sources"), F.count("t").alias("hydrated"))


@query("SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey IS NOT NULL)), '|'), '') AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j5_profile_hydration(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.array_join("p", "|"), F.lit("")).alias("priorities"))


@query("SELECT 'known' AS kind, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'new', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j8_membership(spark, sf_dir):
    d, bad = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    known = d.join(bad, "doc_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("known").alias("kind"), "n")
    return known.union(d.join(bad, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("kind"), "n"))


WATCH = [(1, "thon", 0.5), (1, "erin", 0.2), (2, "attion", 0.9), (3, "thble", 0.4)]


@query(rf"WITH {S.ARTICLES}, w(user_id, word, weight) AS (VALUES {', '.join(map(str, WATCH))}) SELECT user_id, count(DISTINCT doc_id) AS n, round(sum(weight), 4) AS total FROM art, w WHERE contains(lower(clean_text), word) GROUP BY user_id")
def j9_watchlist(spark, sf_dir):
    """Substring join with a short list of words: a loop over the broadcast list, with no text shuffled."""
    w = spark.createDataFrame(WATCH, "user_id int, word string, weight double")
    hits = articles(spark, sf_dir).select("doc_id", F.lower("clean_text").alias("t")).join(F.broadcast(w), F.col("t").contains(F.col("word")))
    return hits.groupBy("user_id").agg(F.countDistinct("doc_id").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query("WITH l AS (SELECT user_id, event_id, value - lag(value) OVER w AS dv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS dt, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(dv / dt, 6) AS velocity FROM l WHERE dt > 0 AND dv / dt > 2 AND value > 20")
def w2_velocity(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") - F.lag("value").over(w)).alias("dv"), ((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 60e6).alias("dt"))
    return e.filter((F.col("dt") > 0) & (F.col("dv") / F.col("dt") > 2) & (F.col("value") > 20)).select("event_id", F.round(F.col("dv") / F.col("dt"), 6).alias("velocity"))


@query("WITH s AS (SELECT date_trunc('day', ts) AS d, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, round(v, 6) AS mean, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY d), 6) AS change FROM s")
def w6_trends(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.avg("value").alias("v"))
    before = F.lag("v").over(Window.partitionBy("event_type").orderBy("w.start"))
    return s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", F.round("v", 6).alias("mean"), F.round(F.col("v") - before, 6).alias("change"))


@query("WITH l AS (SELECT user_id, event_type, lag(event_type) OVER w AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_type AS current, before AS previous, event_type IS DISTINCT FROM before AS changed FROM l WHERE k = 1")
def w8_format_change(spark, sf_dir):
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("previous", F.lag("event_type").over(w.orderBy("ts", "event_id"))).withColumn("k", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).filter("k = 1")
    return e.select("user_id", F.col("event_type").alias("current"), "previous", (~F.col("event_type").eqNullSafe(F.col("previous"))).alias("changed"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def w4_trailing_hour(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("in_hour"))


@query(f"WITH {S.ATTEMPTS} SELECT source_id, round(list_reduce(list(CASE WHEN success THEN 0.05::DOUBLE ELSE -0.2::DOUBLE END ORDER BY ts, event_id), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x)), 0.5::DOUBLE), 6) AS score FROM att GROUP BY source_id")
def p9_reliability(spark, sf_dir):
    """+0.05 for a success, -0.2 for a failure, within 0 and 1, from one half."""
    walks = clamped_walks(attempts(spark, sf_dir), "source_id", ["ts", "event_id"], F.when(F.col("success"), 0.05).otherwise(-0.2), 0.5)
    return walks.select("source_id", F.round("value", 6).alias("score"))


@query(f"WITH {S.ATTEMPTS} SELECT source_id, round(list_reduce(list(CASE WHEN success THEN 0.3::DOUBLE + 0.05::DOUBLE * least(k % 7, 5) ELSE -0.1::DOUBLE END ORDER BY ts, event_id), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x)), 0.5::DOUBLE), 6) AS hunger, round(300 - 270 * list_reduce(list(CASE WHEN success THEN 0.3::DOUBLE + 0.05::DOUBLE * least(k % 7, 5) ELSE -0.1::DOUBLE END ORDER BY ts, event_id), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x)), 0.5::DOUBLE), 4) AS delay FROM att GROUP BY source_id")
def s18_hunger(spark, sf_dir):
    """Hunger by hits and misses, and the delay between 300 and 30 seconds that follows."""
    step = F.when(F.col("success"), 0.3 + 0.05 * F.least(F.col("k") % 7, F.lit(5))).otherwise(-0.1)
    h = clamped_walks(attempts(spark, sf_dir), "source_id", ["ts", "event_id"], step, 0.5)
    return h.select("source_id", F.round("value", 6).alias("hunger"), F.round(300 - 270 * F.col("value"), 4).alias("delay"))


@query("WITH l AS (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 6e7 AS gap FROM events) SELECT event_id, user_id FROM l WHERE gap IS NULL OR gap >= 30")
def r14_cooldown(spark, sf_dir):
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 6e7
    return table(spark, sf_dir, "events").withColumn("gap", gap).filter("gap IS NULL OR gap >= 30").select("event_id", "user_id")


@query("SELECT event_id, k % 4 - 0.05 * (k % 13) AS effective FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) ORDER BY effective, event_id LIMIT 100")
def r3_queue_order(spark, sf_dir):
    """Priority less 0.05 for each second of waiting, then arrival."""
    e = attempts(spark, sf_dir).select("event_id", (F.col("k") % 4 - 0.05 * (F.col("k") % 13)).alias("effective"))
    return e.orderBy("effective", "event_id").limit(100)


@query("SELECT event_id, user_id, ts >= TIMESTAMP '2024-01-30 20:00:00' OR event_type <> 'error' AS eligible FROM events")
def p13_eligible(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", ((F.col("ts") >= F.lit("2024-01-30 20:00:00").cast("timestamp")) | (F.col("event_type") != "error")).alias("eligible"))

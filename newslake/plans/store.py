"""Queries of changes to tables, sinks and ordered state (sections 2.12 and 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.operators import folds as FO
from newslake.operators import store as K
from newslake.plans import sql as S
from newslake.plans.aggregates import attempts
from newslake.plans.registry import query
from newslake.plans.scalars import articles
from newslake.sources.adapters import table


@query("WITH r AS (SELECT o_orderkey, o_totalprice, 0 AS fresh, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 1, o_orderdate FROM orders WHERE o_orderkey % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY fresh DESC, o_orderdate DESC) AS n FROM r) SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM k WHERE n = 1")
def k1_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    out = K.upserted(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"], "o_orderdate")
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("WITH r AS (SELECT user_id, min(ts) FILTER (ts < TIMESTAMP '2024-01-15') AS a, min(ts) AS b, max(ts) AS c FROM events GROUP BY user_id) SELECT user_id, CAST(floor(epoch_us(coalesce(a, b)) / 1e6) AS BIGINT) AS first_seen, CAST(floor(epoch_us(c) / 1e6) AS BIGINT) AS last_updated FROM r")
def k2_event_upsert(spark, sf_dir):
    """K2: a root's first_seen stays, its last_updated follows."""
    e = table(spark, sf_dir, "events")
    root = lambda rows: rows.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_updated"))
    cut = F.lit("2024-01-15").cast("timestamp")
    out = K.upserted(root(e.filter(F.col("ts") < cut)), root(e.filter(F.col("ts") >= cut)), ["user_id"], "last_updated", kept=["first_seen"])
    return out.select("user_id", F.floor(F.unix_micros("first_seen") / 1e6).alias("first_seen"), F.floor(F.unix_micros("last_updated") / 1e6).alias("last_updated"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def k3_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = K.cascaded({"orders": (o, "o_orderkey"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, o.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key")))
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("orders").union(count("lineitem"))


@query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS kept FROM events")
def k4_retention(spark, sf_dir):
    return K.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10").cast("timestamp"))[1]


@query("SELECT 'customer' AS name, count(*) FILTER (c_custkey % 50 = 1) AS erased FROM customer UNION ALL SELECT 'orders', count(*) FILTER (o_custkey % 50 = 1) FROM orders UNION ALL SELECT 'events', count(*) FILTER (user_id % 50 = 1) FROM events")
def k5_erasure(spark, sf_dir):
    users = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 1").select(F.col("c_custkey").alias("key")).union(table(spark, sf_dir, "events").filter("user_id % 50 = 1").select(F.col("user_id").alias("key")).distinct())
    tables = {"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "orders": (table(spark, sf_dir, "orders"), "o_custkey"), "events": (table(spark, sf_dir, "events"), "user_id")}
    left = K.cascaded(tables, users)
    parts = [rows.agg(F.count("*").alias("a")).crossJoin(left[n].agg(F.count("*").alias("b"))).select(F.lit(n).alias("name"), (F.col("a") - F.col("b")).alias("erased")) for n, (rows, _) in tables.items()]  # one row each
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT user_id, '[' || string_agg('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}', ',' ORDER BY event_id) || ']' AS json FROM events GROUP BY user_id")
def k5_export(spark, sf_dir):
    return K.exported(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 3 = 0)")
def k8_insert_or_ignore(spark, sf_dir):
    """K8, K9 over every document: odd ids are new, some of the even ones are there already."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return K.inserted_or_ignored(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 <> 0 OR doc_id % 3 = 0"), ["doc_id"]).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query(f"WITH {S.ARTICLES}, r AS (SELECT source_name, title, row_number() OVER (PARTITION BY source_name ORDER BY doc_id DESC) AS k FROM art) SELECT source_name, '<h2>' || source_name || '</h2><ul>' || string_agg('<li>' || substring(title, 1, 40) || '</li>', '' ORDER BY k) || '</ul>' AS html FROM r WHERE k <= 3 GROUP BY source_name")
def k10_newsletter(spark, sf_dir):
    from pyspark.sql import Window

    r = articles(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("doc_id")))).filter("k <= 3")
    items = r.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("<li>"), F.substring("title", 1, 40), F.lit("</li>")).alias("li")))).alias("i"))
    return items.select("source_name", F.concat(F.lit("<h2>"), "source_name", F.lit("</h2><ul>"), F.array_join(F.transform("i", lambda x: x["li"]), ""), F.lit("</ul>")).alias("html"))


@query("SELECT 'requests_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def k11_exposition(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select(F.format_string('requests_total{type="%s"} %d', "event_type", "n").alias("line"))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "event_id", "ts", "event_type", "value")


@query()
def r7_health_fsm(spark, sf_dir):
    return FO.last_state(attempts(spark, sf_dir).select("source_id", "event_id", "ts", "success", "status_code"), "source_id", ["ts", "event_id"], FO.health_start, FO.health_step, FO.HEALTH_SCHEMA)


@query()
def r8_discovery_fsm(spark, sf_dir):
    states = list(FO.MOVES)
    target = F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % len(states) + 1).cast("int"))
    rows = _events(spark, sf_dir).select("key", "event_id", "ts", target.alias("target_state"))
    return FO.folded(rows, "key", ["ts", "event_id"], lambda: {"status": "discovered"}, FO.discovery_step, "key bigint, event_id bigint, before string, after string, legal boolean")


@query()
def r10_rate_limit(spark, sf_dir):
    from functools import partial

    return FO.folded(_events(spark, sf_dir).select("key", "event_id", "ts"), "key", ["ts", "event_id"], lambda: {"tokens": 0.0, "at": None}, partial(FO.bucket_step, rate=1 / 3600, size=3.0), "key bigint, event_id bigint, allowed boolean, retry_after double")


@query()
def w4_alert_limit(spark, sf_dir):
    from functools import partial

    rows = _events(spark, sf_dir).filter("value >= 75").select((F.col("key") % 5).alias("key"), "event_id", "ts")
    return FO.folded(rows, "key", ["ts", "event_id"], lambda: {"sent": []}, partial(FO.hourly_step, limit=2), "key bigint, event_id bigint, sent boolean")


@query()
def r11_cache_replay(spark, sf_dir):
    from functools import partial

    rows = _events(spark, sf_dir).select((F.col("key") % 4).alias("key"), "event_id", "ts", (F.col("event_id") * 7 % 50).alias("item"))
    return FO.folded(rows, "key", ["ts", "event_id"], lambda: {"held": {}}, partial(FO.cache_step, size=20, ttl=86400.0), "key bigint, event_id bigint, hit boolean")


@query()
def r9_lease_replay(spark, sf_dir):
    from functools import partial

    rows = _events(spark, sf_dir).select((F.col("key") % 10).alias("key"), "event_id", "ts", (F.col("event_id") % 3).alias("worker"))
    return FO.folded(rows, "key", ["ts", "event_id"], lambda: {"holder": None, "until": 0.0, "token": 0}, partial(FO.lease_step, ttl=3600.0), "key bigint, event_id bigint, acquired boolean, token bigint")


@query("SELECT event_id, channel FROM (SELECT event_id, unnest(CASE event_type WHEN 'error' THEN ['alerts', 'log'] WHEN 'purchase' THEN ['sales'] ELSE ['log'] END) AS channel FROM events) WHERE channel <> 'log'")
def r6_topics(spark, sf_dir):
    """A row for each channel of an event, with the log's left out."""
    channels = F.when(F.col("event_type") == "error", F.array(F.lit("alerts"), F.lit("log"))).when(F.col("event_type") == "purchase", F.array(F.lit("sales"))).otherwise(F.array(F.lit("log")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(channels).alias("channel")).filter("channel <> 'log'")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25' AND event_type = 'click' ORDER BY ts, event_id LIMIT 200")
def r4_since(spark, sf_dir):
    """What came since a time, in order."""
    return table(spark, sf_dir, "events").filter((F.col("ts") > F.lit("2024-01-25").cast("timestamp")) & (F.col("event_type") == "click")).orderBy("ts", "event_id").limit(200).select("event_id")

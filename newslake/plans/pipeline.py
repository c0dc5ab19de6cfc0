"""Queries of the pipeline stages (section 2.2 of the survey) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import text as T
from newslake.lexicons import CLICKBAIT, CORPUS_EXCLUSIONS, CORPUS_TAXONOMY, PAYWALL
from newslake.operators import stages as G
from newslake.plans import sql as S
from newslake.plans.registry import q, query
from newslake.plans.scalars import NOW, articles, joined, now
from newslake.sources.adapters import page_observations, table

_AGE = f"greatest({S.minutes('published_at', f'TIMESTAMP {q(NOW)}')}, 0.0)"
_N = f"""n AS (SELECT page_id, source_id, observed_at, published_at, {S.canonical('url')} AS canonical_url, {S.headline('raw_title')} AS title, {S.summary('raw_summary')} AS summary, CASE WHEN published_at IS NOT NULL THEN {_AGE} END AS age, substring(sha256(source_id || '|' || lower(trim(url))), 1, 20) AS id FROM obs)"""


def _points(fields: list[tuple[str, float]], word: str) -> str:
    return "CASE " + " ".join(f"WHEN {S.has(t, word)} THEN {w}" for t, w in fields) + " ELSE 0.0 END"


def _relevance(fields: list[tuple[str, float]], title: str, tags: str) -> dict[str, str]:
    total = " + ".join(_points(fields, w) for ws in CORPUS_TAXONOMY.values() for w in ws)
    cats = "list_filter([" + ", ".join(f"CASE WHEN {' + '.join(_points(fields, w) for w in CORPUS_TAXONOMY[c])} > 0 THEN {q(c)} END" for c in sorted(CORPUS_TAXONOMY)) + "], lambda x: x IS NOT NULL)"
    excluded = " OR ".join(f"contains({title}, {q(x)}) OR contains({tags}, {q(x)})" for x in CORPUS_EXCLUSIONS)
    score = f"CASE WHEN {excluded} THEN 0.1 WHEN {total} = 0 THEN 0.15 ELSE round(least(0.95, 0.45 + ({total}) * 0.08 + len({cats}) * 0.05), 3) END"
    return {"score": score, "cats": f"CASE WHEN {excluded} THEN '' ELSE array_to_string({cats}, '|') END"}


_ANY = lambda t, ps: " OR ".join(f"regexp_matches({t}, {q('(?i)' + p)})" for p in ps)


def _quality(title: str, body: str, summary: str) -> tuple[str, str]:
    n = S.word_count(f"trim({body} || ' ' || {summary})")
    letters = rf"regexp_replace({title}, '[^\p{{L}}]', '', 'g')"
    caps = rf"length(regexp_replace({letters}, '[^\p{{Lu}}]', '', 'g'))"
    short = f"({n} < 15 AND {summary} = '')"
    rules = [("EXTREMELY_SHORT_CONTENT", 0.45, short), ("LOW_WORD_COUNT", 0.25, f"(NOT {short} AND {n} < 30)"), ("ALL_CAPS_HEADLINE", 0.30, f"(length({letters}) >= 10 AND {caps} / greatest(length({letters}), 1) > 0.7)"), ("CLICKBAIT_HEADLINE", 0.35, f"({_ANY(title, CLICKBAIT)})"), ("PAYWALL_TRUNCATED", 0.30, f"({_ANY(body, PAYWALL)} OR {_ANY(summary, PAYWALL)})")]
    penalty = " + ".join(f"CASE WHEN {c} THEN CAST({p} AS DOUBLE) ELSE 0.0 END" for _, p, c in rules)
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for r, _, c in rules) + "], lambda x: x IS NOT NULL)"
    return f"round(greatest(0.05, least(1.0, 1 - ({penalty}))), 3)", reasons


_RP = _relevance([("lower(title)", 3.0), ("lower(summary)", 2.0), ("''", 2.0), ("''", 1.0)], "lower(title)", "''")
_QP = _quality("title", "''", "summary")


@query(f"""WITH {S.PAGES}, {_N}, f AS (SELECT *, {S.level('age')} AS freshness, {_RP['score']} AS rel, {_QP[0]} AS qual, {_QP[1]} AS reasons FROM n),
s AS (SELECT *, CASE WHEN canonical_url IS NULL OR title IS NULL THEN 's01_normalizer' WHEN freshness = 'stale' THEN 's02_freshness' WHEN rel < 0.4 THEN 's03_relevance' WHEN qual < 0.5 THEN 's04_quality' END AS stage FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY canonical_url, stage IS NULL ORDER BY observed_at, id) AS place FROM s)
SELECT source_id, CASE WHEN stage IS NULL AND place > 1 THEN 's05_dedup' ELSE coalesce(stage, 'accepted') END AS outcome, count(*) AS n FROM d GROUP BY ALL""")
def news_pipeline(spark, sf_dir):
    """The flagship: pages to observations to articles, through five stages, counted by source and outcome."""
    rows = G.normalized(page_observations(table(spark, sf_dir, "pages")))
    rows = G.good(G.relevant(G.fresh(rows, now()), CORPUS_TAXONOMY, CORPUS_EXCLUSIONS))
    rows = G.first_by_url(rows)
    return rows.groupBy("source_id", F.coalesce("rejected_at_stage", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {S.PAGES}, {_N} SELECT page_id, canonical_url, title, summary, substring(sha256(canonical_url), 1, 16) AS article_id FROM n")
def p1_normalize(spark, sf_dir):
    return G.normalized(page_observations(table(spark, sf_dir, "pages"))).select("page_id", "canonical_url", "title", "summary", "article_id")


@query(f"WITH {S.PAGES}, {_N} SELECT page_id, {S.level('age')} AS freshness, {S.score('age')} AS freshness_score FROM n")
def p2_freshness(spark, sf_dir):
    return G.fresh(G.normalized(page_observations(table(spark, sf_dir, "pages"))), now()).select("page_id", "freshness", "freshness_score")


_RD = _relevance([("lower(title)", 3.0), ("''", 2.0), ("lower(lang)", 2.0), ("lower(substring(clean_text, 1, 3000))", 1.0)], "lower(title)", "lower(lang)")


@query(f"WITH {S.ARTICLES} SELECT doc_id, {_RD['score']} AS relevance_score, {_RD['cats']} AS categories FROM art")
def p3_relevance(spark, sf_dir):
    return G.relevant(articles(spark, sf_dir), CORPUS_TAXONOMY, CORPUS_EXCLUSIONS).select("doc_id", "relevance_score", joined(F.col("categories")).alias("categories"))


_QD = _quality("title", "clean_text", "''")


@query(f"WITH {S.ARTICLES} SELECT doc_id, {_QD[0]} AS quality_score, {_QD[0]} >= 0.5 AS is_passed, CASE WHEN {_QD[0]} >= 0.5 THEN '' ELSE array_to_string({_QD[1]}, '|') END AS reasons FROM art")
def p4_quality(spark, sf_dir):
    return G.good(articles(spark, sf_dir)).select("doc_id", "quality_score", "is_passed", joined(F.col("quality_reasons")).alias("reasons"))


@query(f"""WITH {S.PAGES}, a AS (SELECT page_id, published_at, {S.minutes('coalesce(published_at, observed_at)', "TIMESTAMP '2024-01-31 04:00:00'")} AS age FROM obs)
SELECT page_id, CASE WHEN age < -5 THEN 'future_timestamp' WHEN age <= 30 THEN 'fresh' WHEN age <= 60 THEN 'soft_fresh' ELSE 'too_old' END AS reason, CASE WHEN published_at IS NOT NULL THEN 1.0 ELSE 0.5 END AS confidence, age <= 60 AND age >= -5 AS fresh FROM a""")
def p5_breaking_gate(spark, sf_dir):
    g = G.breaking_gate(F.col("published_at_hint"), F.col("observed_at"), F.lit("2024-01-31 04:00:00").cast("timestamp"))
    return page_observations(table(spark, sf_dir, "pages")).select("page_id", g["gate_reason"].alias("reason"), g["gate_confidence"].alias("confidence"), g["gate_fresh"].alias("fresh"))


_WORDS = sorted(CORPUS_TAXONOMY["alpha"] + CORPUS_TAXONOMY["beta"])
_SPAM = f"({_ANY('title', CLICKBAIT)} OR regexp_matches(title, {q(r'(?i)' + chr(92) + 'b(casino|viagra|lottery|free money)' + chr(92) + 'b')}))"
_TECH = " OR ".join(S.has("lower(title || ' ' || clean_text)", w) for w in _WORDS)


@query(f"WITH {S.ARTICLES}, v AS (SELECT CASE WHEN {_SPAM} THEN 'spam' WHEN length(title) < 15 OR {S.word_count('clean_text')} < 20 THEN 'low_quality' WHEN NOT ({_TECH}) THEN 'not_tech' WHEN {S.minutes('discovered_at', q('2024-01-03') + '::TIMESTAMP')} / 60 > 40 THEN 'stale' ELSE 'passed' END AS reason FROM art) SELECT reason, count(*) AS n FROM v GROUP BY reason")
def p6_quality_filter(spark, sf_dir):
    hours = D.minutes_between(F.col("discovered_at"), F.lit("2024-01-03").cast("timestamp")) / 60
    verdict = G.legacy_verdict(F.col("title"), F.col("clean_text"), hours, _WORDS, 40.0)
    return articles(spark, sf_dir).select(verdict.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {S.ARTICLES}, v AS (SELECT doc_id, CASE WHEN length(trim(title)) < 15 THEN 'title_too_short' WHEN length(trim(clean_text)) < 20 THEN 'summary_too_short' WHEN doc_id % 3 = 0 THEN 'no_image' ELSE 'ok' END AS verdict FROM art) SELECT * FROM v")
def p8_publishable(spark, sf_dir):
    image = F.when(F.col("doc_id") % 3 != 0, "x.png")
    return articles(spark, sf_dir).select("doc_id", G.publishable(F.col("title"), F.lit("https://x"), F.col("clean_text"), image).alias("verdict"))


@query(f"SELECT doc_id, length(text) >= 400 AND (length(text) >= 5000 OR NOT ({_ANY('text', PAYWALL)})) AS valid FROM documents")
def p16_valid_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.valid_content(F.col("text")).alias("valid"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def p10_time_range(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))).select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') AND (contains(lower(text), 'thon') OR source = 'src4')")
def p11_preferences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blocked = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    return d.join(F.broadcast(blocked), "source", "left_anti").filter(F.lower("text").contains("thon") | (F.col("source") == "src4")).select("doc_id")


@query("WITH u AS (SELECT column_name AS field FROM (VALUES ('email'), ('user_id'), ('ip_address'), ('title'), ('password'), ('url')) t(column_name)) SELECT field, CASE field WHEN 'email' THEN 'personal' WHEN 'user_id' THEN 'personal' WHEN 'ip_address' THEN 'sensitive' WHEN 'password' THEN 'secret' ELSE 'public' END AS class FROM u")
def p14_field_classes(spark, sf_dir):
    named = {"email": "personal", "user_id": "personal", "ip_address": "sensitive", "password": "secret"}
    classes = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    fields = spark.createDataFrame([(f,) for f in ("email", "user_id", "ip_address", "title", "password", "url")], "field string")
    return fields.select("field", F.coalesce(F.try_element_at(classes, F.col("field")), F.lit("public")).alias("class"))


@query(f"""WITH {S.PAGES}, a AS (SELECT page_id, {S.minutes('published_at', "TIMESTAMP '2024-01-31 04:00:00'")} AS age, length(raw_title) AS n, row_number() OVER (PARTITION BY {S.canonical('url')} ORDER BY observed_at, page_id) AS place FROM obs)
SELECT route, count(*) AS n FROM (SELECT CASE WHEN place > 1 THEN 'duplicate' WHEN age BETWEEN -5 AND 60 AND n >= 20 THEN 'breaking' WHEN n >= 10 THEN 'standard' ELSE 'rejected' END AS route FROM a) GROUP BY route""")
def p15_breaking_routes(spark, sf_dir):
    from pyspark.sql import Window

    from newslake.functions import url as U

    o = page_observations(table(spark, sf_dir, "pages"))
    place = F.row_number().over(Window.partitionBy(U.canonical_url(F.col("url"))).orderBy("observed_at", "page_id"))
    age, n = D.minutes_between(F.col("published_at_hint"), F.lit("2024-01-31 04:00:00").cast("timestamp")), F.length("title")
    route = F.when(F.col("place") > 1, "duplicate").when(age.between(-5, 60) & (n >= 20), "breaking").when(n >= 10, "standard").otherwise("rejected")
    return o.withColumn("place", place).select(route.alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thtion') AND source = 'src5' AND (doc_id % 10 = 0 OR doc_id BETWEEN 100 AND 900)")
def p17_history(spark, sf_dir):
    """Substring, exact source and a range of dates that undated rows pass."""
    a = articles(spark, sf_dir).withColumn("dated", F.when(F.col("doc_id") % 10 != 0, F.col("discovered_at")))
    at = lambda m: F.timestamp_seconds(F.lit(1704067200 + m * 60))
    inside = F.col("dated").isNull() | F.col("dated").between(at(100), at(900))
    return a.filter(F.lower("clean_text").contains("thtion") & (F.col("source_name") == "src5") & inside).select("doc_id")

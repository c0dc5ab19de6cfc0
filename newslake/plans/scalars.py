"""Queries of the scalar functions (section 2.7 and 2.9 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import pii
from newslake.functions import text as T
from newslake.functions import url as U
from newslake.lexicons import CORPUS_GAZETTEER, CORPUS_NEGATIVE, CORPUS_POSITIVE, CORPUS_STOP, CORPUS_TAXONOMY, CORPUS_WEIGHTS, TRACKING
from newslake.operators.automaton import tallies
from newslake.plans import sql as S
from newslake.plans.registry import q, query
from newslake.sources.adapters import document_articles, event_attempts, page_observations, table

NOW = "2024-02-01 00:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_articles(table(spark, sf_dir, "documents"))


def joined(column: F.Column) -> F.Column:
    return F.array_join(column, "|")


@query(f"SELECT page_id, {S.canonical('url')} AS canonical_url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages")
def f1_url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"), U.host(F.col("url")).alias("host"))


_U2 = "regexp_replace(lower(trim(url)), '#.*$', '')"
_P2 = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({_U2}, '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT list_contains({S.literal_list([*TRACKING, 'source', 'via'])}, split_part(p, '=', 1)))), '&')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(split_part({_U2}, '?', 1), '^[a-z][a-z0-9+.-]*://(www\.)?', ''), '/+$', '') || CASE WHEN {_P2} <> '' THEN '?' || {_P2} ELSE '' END AS loose_url FROM pages")
def f2_url_loose(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.loose_url(F.col("url")).alias("loose_url"))


@query(f"WITH {S.PAGES} SELECT page_id, {S.headline('raw_title')} AS title FROM obs")
def f3_title_clean(spark, sf_dir):
    return page_observations(table(spark, sf_dir, "pages")).select("page_id", T.clean_headline(F.col("title")).alias("title"))


@query(f"WITH {S.PAGES} SELECT page_id, {S.summary('raw_summary')} AS summary FROM obs")
def f4_summary_clean(spark, sf_dir):
    return page_observations(table(spark, sf_dir, "pages")).select("page_id", T.clean_summary(F.col("summary")).alias("summary"))


@query(rf"WITH {S.ARTICLES} SELECT doc_id, regexp_replace(regexp_replace(trim(CAST(doc_id % 9 + 1 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE 'D ' END || title), '^#?\d{{1,3}}\s*[.):\-]\s+', ''), '^#\d{{1,3}}\s+', '') AS title FROM art")
def f5_title_rank(spark, sf_dir):
    made = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, ". ").otherwise("D "), F.col("title"))
    return articles(spark, sf_dir).select("doc_id", T.sanitized_title(made).alias("title"))


@query(rf"WITH {S.ARTICLES} SELECT doc_id, {S.SQUEEZE.format(r"regexp_replace(regexp_replace(lower(trim('Update: ' || title)), '^(breaking|update|updated|exclusive|watch|video|opinion)\s*:\s*', ''), '[^\p{L}\p{N}_\s]', ' ', 'g')")} AS plain_title FROM art")
def f6_title_plain(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.plain_title(F.concat(F.lit("Update: "), F.col("title"))).alias("plain_title"))


@query(rf"""WITH {S.ARTICLES}, w AS (SELECT doc_id, {S.words('title')} AS w FROM art)
SELECT doc_id, CAST(len(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS BIGINT) AS n_shingles,
CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS BIGINT) AS n_runs FROM w""")
def f7_shingles(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.size(T.shingles(F.col("title"))).cast("bigint").alias("n_shingles"), F.size(T.word_runs(F.col("title"))).cast("bigint").alias("n_runs"))


@query()
def f8_edit_ratio(spark, sf_dir):
    """Over whole titles and all characters; DuckDB counts edits in bytes, so tests hold the values."""
    return f8_edit_ratio_whole(spark, sf_dir)


@query()
def f8_edit_ratio_whole(spark, sf_dir):
    """Over whole titles and all characters."""
    a = articles(spark, sf_dir).select("doc_id", F.col("title").alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.edit_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query()
def f8_fuzzy_score(spark, sf_dir):
    a = articles(spark, sf_dir).select("doc_id", F.col("title").alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.similarity_score(F.col("a"), F.col("b")), 6).alias("score"))


@query(rf"WITH {S.PAGES}, {S.ARTICLES} SELECT page_id, substring(sha256(source_id || '|' || lower(trim(url))), 1, 20) AS observation_id, substring(sha256({S.canonical('url')}), 1, 16) AS article_id, substring(md5(lower(trim(url))), 1, 16) AS source_key, substring(sha256('event:' || {S.SQUEEZE.format('lower(raw_title)')} || '|' || strftime(observed_at, '%Y-%m-%d')), 1, 16) AS event_id FROM obs")
def f9_ids(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    return o.select("page_id", F.col("id").alias("observation_id"), T.hash_id(U.canonical_url(F.col("url"))).alias("article_id"), T.hash_id(F.lower(F.trim("url")), 16, 0).alias("source_key"), T.event_id(F.col("title"), F.col("observed_at")).alias("event_id"))


_cats = {c: " OR ".join(S.has("lower(clean_text)", w) for w in CORPUS_TAXONOMY[c]) for c in sorted(CORPUS_TAXONOMY)}


@query(rf"WITH {S.ARTICLES} SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {v} THEN {q(c)} END' for c, v in _cats.items())}], lambda x: x IS NOT NULL), '|') AS categories FROM art")
def f13_categories(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", joined(T.matched_categories(F.lower("clean_text"), CORPUS_TAXONOMY)).alias("categories"))


def classified(text: F.Column) -> F.Column:
    """F14, a struct: primary category by hits, up to two more, confidence and up to five keywords; else Technology at 0.3."""
    every = sorted({w for ws in CORPUS_TAXONOMY.values() for w in ws})
    return T.let(T.present_words(text, every), lambda own: _classified({c: F.array_intersect(F.array(*map(F.lit, sorted(ws))), own) for c, ws in CORPUS_TAXONOMY.items()}))


def _classified(hits: dict[str, F.Column]) -> F.Column:
    scored = F.array_sort(F.filter(F.array(*(F.struct((-F.size(hits[c])).alias("n"), F.lit(c).alias("c")) for c in sorted(hits))), lambda x: x["n"] < 0))
    total = reduce(lambda a, b: a + b, (F.size(h) for h in hits.values()))
    words = F.slice(F.array_sort(F.flatten(F.array(*hits.values()))), 1, 5)
    own = {"primary": F.coalesce(F.try_element_at(scored, F.lit(1))["c"], F.lit("Technology")), "secondary": joined(F.transform(F.slice(scored, 2, 2), lambda x: x["c"])), "confidence": F.when(total == 0, 0.3).otherwise(F.round(F.least(F.lit(0.9), 0.5 + 0.1 * total), 3)), "keywords": joined(words)}
    return F.struct(*(v.alias(k) for k, v in own.items()))


def _hits(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {S.has('t', w)} THEN {q(w)} END" for w in CORPUS_TAXONOMY[c]) + "], lambda x: x IS NOT NULL)"


@query(rf"""WITH {S.ARTICLES}, h AS (SELECT doc_id, [{', '.join(f"{{'n': -len({_hits(c)}), 'c': {q(c)}}}" for c in sorted(CORPUS_TAXONOMY))}] AS cs, list_concat({', '.join(_hits(c) for c in CORPUS_TAXONOMY)}) AS ws FROM (SELECT doc_id, lower(clean_text) AS t FROM art)),
s AS (SELECT doc_id, list_sort(list_filter(cs, lambda x: x.n < 0)) AS cs, ws FROM h)
SELECT doc_id, coalesce(cs[1].c, 'Technology') AS "primary", array_to_string(list_transform(cs[2:3], lambda x: x.c), '|') AS secondary, CASE WHEN len(ws) = 0 THEN 0.3 ELSE round(least(0.9, 0.5 + 0.1 * len(ws)), 3) END AS confidence, array_to_string(list_sort(ws)[1:5], '|') AS keywords FROM s""")
def f14_classify(spark, sf_dir):
    # exploded, so that the plan does not repeat the struct for each of its fields
    rows = articles(spark, sf_dir).select("doc_id", F.explode(F.array(classified(F.lower("clean_text")))).alias("f"))
    return rows.select("doc_id", "f.*")


@query(rf"WITH {S.ARTICLES} SELECT doc_id, " + ", ".join(f"array_to_string(list_filter([{', '.join(f'CASE WHEN {S.has("lower(clean_text)", w)} THEN {q(w)} END' for w in sorted(ws))}], lambda x: x IS NOT NULL)[1:10], '|') AS {k}" for k, ws in CORPUS_GAZETTEER.items()) + r", array_to_string(list_sort(list_distinct(regexp_extract_all(clean_text, '[A-Z][a-z]{5,} [A-Z][a-z]{5,}')))[1:15], '|') AS names FROM art")
def f15_entities(spark, sf_dir):
    names = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("clean_text", F.lit("([A-Z][a-z]{5,} [A-Z][a-z]{5,})"), F.lit(1)))), 1, 15)
    return articles(spark, sf_dir).select("doc_id", *(joined(F.slice(T.matched(F.lower("clean_text"), ws), 1, 10)).alias(k) for k, ws in CORPUS_GAZETTEER.items()), joined(names).alias("names"))


def point_score(s: F.Column) -> F.Column:
    """F16: worth of a sentence: phrases, quotes and numbers."""
    phrases = reduce(lambda a, b: a + b, (F.when(T.present(F.lower(s), w), 0.15).otherwise(0.0) for w in CORPUS_POSITIVE))
    return phrases + F.when(s.rlike("[\"“”]"), 0.2).otherwise(0.0) + F.when(s.rlike("[0-9]"), 0.15).otherwise(0.0)


_point = " + ".join(f"CASE WHEN {S.has('lower(s)', w)} THEN 0.15 ELSE 0.0 END" for w in CORPUS_POSITIVE) + " + CASE WHEN regexp_matches(s, '[\"“”]') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(s, '[0-9]') THEN 0.15 ELSE 0.0 END"


@query(rf"""WITH {S.ARTICLES}, s AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(clean_text, '([^.!?]+[.!?]+|[^.!?]+$)', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS s, unnest(range(len(regexp_extract_all(clean_text, '([^.!?]+[.!?]+|[^.!?]+$)', 1)))) AS i FROM art),
p AS (SELECT doc_id, i, s, round({_point}, 3) AS score FROM s WHERE length(s) > 50 AND length(s) < 300), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM p WHERE score > 0.3)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(i AS BIGINT) AS position, score, CASE WHEN rank = 1 THEN 'main' WHEN rank <= 3 THEN 'supporting' ELSE 'detail' END AS role, s AS sentence FROM r WHERE rank <= 5""")
def f16_key_points(spark, sf_dir):
    points = F.transform(T.sentences(F.col("clean_text")), lambda s, i: F.struct((-F.round(point_score(s), 3)).alias("m"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(F.filter(points, lambda p: (p["m"] < -0.3) & (F.length(p["s"]) > 50) & (F.length(p["s"]) < 300))), 1, 5)
    rows = articles(spark, sf_dir).select("doc_id", F.posexplode(best).alias("at", "p"))
    role = F.when(F.col("at") == 0, "main").when(F.col("at") <= 2, "supporting").otherwise("detail")
    return rows.select("doc_id", (F.col("at") + 1).cast("bigint").alias("rank"), F.col("p.i").cast("bigint").alias("position"), (-F.col("p.m")).alias("score"), role.alias("role"), F.col("p.s").alias("sentence"))


_cnt = lambda ws: f"len(list_filter({S.words('clean_text')}, lambda x: list_contains({S.literal_list(ws)}, x)))"
_sent = f"({_cnt(CORPUS_POSITIVE)} - {_cnt(CORPUS_NEGATIVE)}) / ({_cnt(CORPUS_POSITIVE)} + {_cnt(CORPUS_NEGATIVE)} + 1)"
_label = "CASE WHEN x >= 0.5 THEN 'very_positive' WHEN x >= 0.15 THEN 'positive' WHEN x <= -0.5 THEN 'very_negative' WHEN x <= -0.15 THEN 'negative' ELSE 'neutral' END"


@query(rf"WITH {S.ARTICLES}, d AS (SELECT doc_id, len(list_filter(list_distinct({S.words('clean_text')}), lambda x: list_contains({S.literal_list(CORPUS_POSITIVE)}, x))) AS p, len(list_filter(list_distinct({S.words('clean_text')}), lambda x: list_contains({S.literal_list(CORPUS_NEGATIVE)}, x))) AS n FROM art) SELECT doc_id, CASE WHEN p > 1.5 * n THEN 'positive' WHEN n > 1.5 * p THEN 'negative' ELSE 'neutral' END AS sentiment FROM d")
def f17_set_sentiment(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", T.set_sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE).alias("sentiment"))


@query(rf"WITH {S.ARTICLES}, s AS (SELECT doc_id, {_sent} AS x FROM art) SELECT doc_id, round(x, 6) AS score, {_label} AS label FROM s")
def f18_sentiment(spark, sf_dir):
    s = T.sentiment(F.col("clean_text"), CORPUS_POSITIVE, CORPUS_NEGATIVE)
    return articles(spark, sf_dir).select("doc_id", F.round(s, 6).alias("score"), T.sentiment_label(s).alias("label"))


@query(f"SELECT doc_id, {S.word_count('text')} AS n_words, greatest(1, {S.word_count('text')} // 200) AS minutes FROM documents")
def f19_reading_time(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"), T.reading_minutes(F.col("text")).cast("bigint").alias("minutes"))


@query(rf"WITH {S.ARTICLES} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter([{', '.join(f'CASE WHEN {v} THEN {q('#' + c)} END' for c, v in _cats.items())}], lambda x: x IS NOT NULL), ['#news'])))[1:4], ' ') AS hashtags FROM art")
def f20_hashtags(spark, sf_dir):
    cats = F.transform(T.matched_categories(F.lower("clean_text"), CORPUS_TAXONOMY), lambda c: F.concat(F.lit("#"), c))
    return articles(spark, sf_dir).select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.concat(cats, F.array(F.lit("#news"))))), 1, 4), " ").alias("hashtags"))


def trimmed_to_html(text: F.Column, budget: int) -> F.Column:
    """the longest start of ``text`` whose escaped form fits ``budget``; escaped lengths are running sums."""
    chars = F.split(text, "")
    size = F.transform(chars, lambda c: F.when(c == "&", 5).when(c.isin("<", ">"), 4).when(c == '"', 6).when(c == "'", 6).otherwise(1))
    # at most ``budget`` characters can fit, so the fold is bounded by it
    kept = F.aggregate(F.slice(size, 1, budget), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.struct((a["n"] + x).alias("n"), F.when(a["n"] + x <= budget, a["k"] + 1).otherwise(a["k"]).alias("k")))
    return F.substr(text, F.lit(1), kept["k"])


@query("WITH c AS (SELECT doc_id, text, list_transform(string_split(substring(text, 1, 160), ''), lambda c: CASE WHEN c = '&' THEN 5 WHEN c IN ('<', '>') THEN 4 WHEN c IN ('\"', '''') THEN 6 ELSE 1 END) AS s FROM documents), k AS (SELECT doc_id, text, len(list_filter(range(1, len(s) + 1), lambda i: list_sum(s[1:i]) <= 160)) AS k FROM c) SELECT doc_id, substring(text, 1, k) AS shown FROM k")
def f21_html_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", trimmed_to_html(F.col("text"), 160).alias("shown"))


@query(r"WITH t AS (SELECT conv_id, turn, regexp_extract(text, '^([^.!?\n]+[.!?]?)', 1) AS f, length(text) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN length(f) <= 100 THEN trim(f) ELSE substring(f, 1, 97) || '...' END AS title, 2 * (n % 7) + n % 11 + 1.5 * (n % 5) + 2.5 * (n % 3) AS engagement FROM t")
def f22_tweets(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tweet_title(F.col("text")).alias("title"), T.engagement(n % 7, n % 11, n % 5, n % 3).cast("double").alias("engagement"))


_luhn = "(list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring(d, 16 - i, 1) AS INT) * 2 - CASE WHEN CAST(substring(d, 16 - i, 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substring(d, 16 - i, 1) AS INT) END)) % 10 = 0)"
_kinds = ", ".join(f"CAST(len(regexp_extract_all(text, {q(p)})) AS BIGINT) AS {k}" for k, p in pii.PATTERNS if k != "card")


@query(f"WITH c AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, {q(dict(pii.PATTERNS)['card'])}), lambda x: regexp_replace(x, '[ -]', '', 'g'))) AS d FROM documents), n AS (SELECT doc_id, count(*) AS card FROM c WHERE {_luhn} GROUP BY doc_id) SELECT d.doc_id, {_kinds}, CAST(coalesce(card, 0) AS BIGINT) AS card FROM documents d LEFT JOIN n USING (doc_id)")
def f23_pii_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in pii.counts(F.col("text")).items()))


@query()
def f23_pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pii.redacted(F.col("text")).alias("text"))


LOG_RULES = [("timeout", "high", r"(?i)time(d )?[ -]?out|ouon"), ("blocked", "high", r"(?i)\b403\b|captcha"), ("parse_error", "medium", r"(?i)parse|erin"), ("rate_limit", "medium", r"(?i)\b429\b|too many")]


@query("WITH l AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {q(n)}" for n, _, p in LOG_RULES) + " ELSE 'none' END AS issue FROM documents) SELECT issue, CASE issue " + " ".join(f"WHEN {q(n)} THEN {q(s)}" for n, s, _ in LOG_RULES) + " ELSE 'low' END AS severity, count(*) AS n FROM l GROUP BY issue")
def f25_log_issues(spark, sf_dir):
    issue = reduce(lambda w, r: w.when(F.col("text").rlike(r[2]), r[0]), LOG_RULES[1:], F.when(F.col("text").rlike(LOG_RULES[0][2]), LOG_RULES[0][0])).otherwise("none")
    severity = reduce(lambda w, r: w.when(F.col("issue") == r[0], r[1]), LOG_RULES[1:], F.when(F.col("issue") == LOG_RULES[0][0], LOG_RULES[0][1])).otherwise("low")
    return table(spark, sf_dir, "documents").select(issue.alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).select("issue", severity.alias("severity"), "n")


@query(r"SELECT route, count(*) AS n FROM (SELECT regexp_replace('/v1/users/' || user_id || '/events/' || event_id || '/' || event_type, '/\d+', '/{id}', 'g') AS route FROM events) GROUP BY route")
def f26_routes(spark, sf_dir):
    path = F.concat_ws("/", F.lit("/v1/users"), "user_id", F.lit("events"), "event_id", "event_type")
    return table(spark, sf_dir, "events").select(T.route_template(path).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {S.ATTEMPTS} SELECT category, backoff, count(*) AS n FROM (SELECT CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code = 404 THEN 'gone' WHEN status_code >= 500 THEN 'server_error' ELSE 'ok' END AS category, CAST(CASE WHEN status_code = 429 THEN 300 WHEN status_code = 404 THEN 604800 WHEN status_code >= 500 THEN 60 ELSE 0 END AS BIGINT) AS backoff FROM att) GROUP BY ALL")
def f27_status(spark, sf_dir):
    a = event_attempts(table(spark, sf_dir, "events"))
    return a.select(T.status_category(F.col("status_code")).alias("category"), T.status_backoff(F.col("status_code")).cast("bigint").alias("backoff")).groupBy("category", "backoff").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/img/' || page_id || '.png' WHEN page_id % 5 = 2 THEN NULL WHEN page_id % 5 = 3 THEN regexp_extract(url, '^([A-Za-z]+)://', 1) || '://cdn.example.com/a.jpg' ELSE regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^/?#]*(/[^?#]*/)?)', 1), '/$', '') || '/b.jpg' END AS image FROM pages")
def f28_images(spark, sf_dir):
    i = F.col("page_id") % 5
    raw = F.when(i == 0, "data:image/png;base64,xx").when(i == 1, F.concat(F.lit("/img/"), F.col("page_id").cast("string"), F.lit(".png"))).when(i == 2, "https://t.example.com/pixel.gif").when(i == 3, "//cdn.example.com/a.jpg").otherwise("b.jpg")
    return table(spark, sf_dir, "pages").select("page_id", U.image_url(raw, F.col("url")).alias("image"))


@query(r"WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '([^.!?]+[.!?]+|[^.!?]+$)', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 20)[1:3] AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s, ' ') ELSE substring(text, 1, 200) END AS summary FROM s")
def f29_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.local_summary(F.col("text")).alias("summary"))


@query(rf"""WITH {S.ARTICLES}, t AS (SELECT doc_id, {S.words('clean_text')} AS w, length(clean_text) AS n FROM art), c AS (SELECT doc_id, n, len(w) AS total, list_sum(list_transform(w, lambda x: CASE x {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in CORPUS_WEIGHTS.items())} ELSE 0 END)) AS mass,
len(list_filter(w, lambda x: list_contains({S.literal_list(list(CORPUS_WEIGHTS))}, x))) AS hits, len(list_filter(list_distinct(w), lambda x: list_contains({S.literal_list(list(CORPUS_WEIGHTS))}, x))) AS uniq FROM t)
SELECT doc_id, CASE WHEN hits = 0 THEN 0.0 ELSE round(least(1.0, (0.4 * mass / hits + 0.4 * least(1.0, hits * 100.0 / total / 5) + least(0.3, 0.05 * uniq)) * (0.5 + 0.5 * least(1.0, n / 500))), 6) END AS tech_score FROM c""")
def f12_tech_score(spark, sf_dir):
    """Weighted keywords: mean weight, hits per hundred words, distinct words, damped for short texts."""
    w = T.words(F.col("clean_text"))
    weight = F.create_map(*(F.lit(x) for kv in CORPUS_WEIGHTS.items() for x in kv))
    rows = articles(spark, sf_dir).select("doc_id", F.length("clean_text").alias("n"), F.size(w).alias("total"), F.filter(w, lambda x: x.isin(*CORPUS_WEIGHTS)).alias("h"))
    mass = F.aggregate("h", F.lit(0.0), lambda a, x: a + weight[x])
    hits = F.size("h")
    score = (0.4 * mass / hits + 0.4 * F.least(F.lit(1.0), hits * 100.0 / F.col("total") / 5) + F.least(F.lit(0.3), 0.05 * F.size(F.array_distinct("h")))) * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n") / 500))
    return rows.select("doc_id", F.when(hits == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 6)).alias("tech_score"))


@query(rf"WITH {S.ARTICLES}, w AS (SELECT doc_id, unnest({S.words('title')}) AS w FROM art) SELECT w AS word, count(*) AS n FROM w WHERE starts_with(w, 'ther') GROUP BY w")
def f11_prefix_words(spark, sf_dir):
    w = articles(spark, sf_dir).select(F.explode(T.words(F.col("title"))).alias("word"))
    return w.filter(F.col("word").startswith("ther")).groupBy("word").agg(F.count("*").alias("n"))


@query(rf"WITH {S.ARTICLES}, p AS (SELECT DISTINCT unnest({S.words('text')}) AS word FROM benchmark), w AS (SELECT doc_id, unnest({S.words('clean_text')}) AS word FROM art) SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w JOIN p USING (word) GROUP BY word")
def f11_all_matches(spark, sf_dir):
    """every word of the benchmark's items, a bounded set, in all texts at once: documents and occurrences."""
    patterns = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word"))
    found = tallies(articles(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lower("clean_text").alias("text")), patterns)
    return found.groupBy("word").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@query(f"WITH p AS (SELECT page_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(TIMESTAMP '2024-01-31' + to_minutes(CAST(page_id AS BIGINT)))) / 60e6 + (page_id % 40) * 360 AS age FROM pages) SELECT page_id, CASE WHEN age < 1 THEN 'just now' WHEN age < 60 THEN CAST(floor(age) AS BIGINT) || ' min' || CASE WHEN floor(age) = 1 THEN '' ELSE 's' END || ' ago' WHEN age < 1440 THEN CAST(floor(age / 60) AS BIGINT) || ' hour' || CASE WHEN floor(age / 60) = 1 THEN '' ELSE 's' END || ' ago' WHEN age < 10080 THEN CAST(floor(age / 1440) AS BIGINT) || ' day' || CASE WHEN floor(age / 1440) = 1 THEN '' ELSE 's' END || ' ago' ELSE CAST(floor(age / 10080) AS BIGINT) || ' week' || CASE WHEN floor(age / 10080) = 1 THEN '' ELSE 's' END || ' ago' END AS shown, CASE WHEN age < 15 THEN 'just_now' WHEN age < 60 THEN 'last_hour' WHEN age < 360 THEN 'last_6_hours' WHEN age < 1440 THEN 'today' WHEN age < 10080 THEN 'this_week' ELSE 'older' END AS band FROM p")
def t3_relative_time(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages"))
    age = D.minutes_between(F.col("observed_at"), now()) + (F.col("page_id") % 40) * 360
    return o.select("page_id", D.relative(age).alias("shown"), D.shown_freshness(age).alias("band"))


@query(f"SELECT page_id, epoch(CASE page_id % 5 WHEN 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(page_id % 30 + 1 AS BIGINT)) WHEN 1 THEN TIMESTAMP '2024-01-05 10:00:00' + to_days(CAST(page_id % 20 AS INTEGER)) WHEN 2 THEN TIMESTAMP '2024-01-05' WHEN 3 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY ELSE NULL END)::BIGINT AS epoch FROM pages")
def t1_dates(spark, sf_dir):
    i = F.col("page_id") % 5
    raw = F.when(i == 0, F.concat((F.col("page_id") % 30 + 1).cast("string"), F.lit(" hours ago"))).when(i == 1, F.date_format(F.timestamp_seconds(F.lit(1704448800) + (F.col("page_id") % 20) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 2, "garbled").when(i == 3, "yesterday").otherwise("no date")
    url = F.when(i == 2, "https://x.example.com/2024/01/05/story").otherwise("https://x.example.com/story")
    return table(spark, sf_dir, "pages").select("page_id", F.unix_timestamp(D.parsed(raw, now(), url)).alias("epoch"))


@query(r"SELECT page_id, CASE WHEN h LIKE '%.net' THEN 'Europe/Berlin' WHEN h LIKE 'blog.%' THEN 'Asia/Tokyo' WHEN h LIKE '%.com' THEN 'America/New_York' ELSE 'UTC' END AS zone FROM (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') AS h FROM pages)")
def t5_zones(spark, sf_dir):
    d = U.domain(F.col("url"))
    zone = F.when(d.endswith(".net"), "Europe/Berlin").when(d.startswith("blog."), "Asia/Tokyo").otherwise(D.zone_of(d, {}, {".com": "America/New_York"}))
    return table(spark, sf_dir, "pages").select("page_id", zone.alias("zone"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS eu, strftime(ts, '%m/%d/%Y %I:%M %p') AS us FROM events")
def t6_regional_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy HH:mm").alias("eu"), F.date_format("ts", "MM/dd/yyyy hh:mm a").alias("us"))


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(last)) / 60e6 >= 1380 AS daily_due, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(last)) / 60e6 >= 10020 AS weekly_due FROM l")
def t7_digest_due(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    at = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return last.select("user_id", D.digest_due(F.col("last"), at, "daily").alias("daily_due"), D.digest_due(F.col("last"), at, "weekly").alias("weekly_due"))


def md5_shard(text: F.Column, n: int) -> F.Column:
    """M2: the md5 digest as a number, modulo ``n``, by folding its hex digits."""
    digits = F.split(F.md5(text), "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("bigint"), F.lit(n)))


@query("WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM pages) SELECT h AS source_id, list_reduce(list_transform(string_split(md5(h), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % 7, CAST(0 AS BIGINT)) AS shard, count(*) AS n FROM p GROUP BY h")
def m2_md5_shards(spark, sf_dir):
    o = page_observations(table(spark, sf_dir, "pages")).groupBy("source_id").agg(F.count("*").alias("n"))
    return o.select("source_id", md5_shard(F.col("source_id"), 7).alias("shard"), "n")


@query("SELECT doc_id, '{\"id\":' || doc_id || ',\"tags\":[\"' || lang || '\"],\"source\":{\"name\":\"' || source || '\",\"tier\":' || (doc_id % 4 + 1) || '}}' AS json, lang AS first_tag, source AS name FROM documents")
def m4_json_round_trip(spark, sf_dir):
    a = articles(spark, sf_dir)
    made = a.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "tags", F.struct(F.col("source_name").alias("name"), F.col("source_tier").alias("tier")).alias("source"))).alias("json"))
    back = F.from_json("json", "id BIGINT, tags ARRAY<STRING>, source STRUCT<name: STRING, tier: INT>")
    return made.select("doc_id", "json", back["tags"][0].alias("first_tag"), back["source"]["name"].alias("name"))


@query(rf"WITH {S.ARTICLES} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([lang], {S.words('title')}[1:3]))), '|') AS terms FROM art")
def m3_arrays(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", joined(F.array_sort(F.array_union("tags", F.slice(T.words(F.col("title")), 1, 3)))).alias("terms"))


@query(f"WITH {S.ARTICLES} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.75 WHEN doc_id % 4 = 1 THEN 0.7 WHEN doc_id % 4 = 2 THEN 0.3 ELSE 0.65 END AS importance FROM art")
def c4_importance(spark, sf_dir):
    made = F.concat_ws(" ", F.when(F.col("doc_id") % 4 == 0, "backdoor in").when(F.col("doc_id") % 4 == 1, "takeover of").when(F.col("doc_id") % 4 == 2, "changelog of").otherwise("outage at"), "title")
    return articles(spark, sf_dir).select("doc_id", T.importance(made).alias("importance"))

"""Stages of the article pipeline (P1-P8, P16, S01-S04): DataFrame in, DataFrame out.

A stage adds columns; rejected rows keep the name of the stage that rejected them and its reason, so
that one chain of projections reports on all rows. ``now`` is always given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newslake.functions import dates as D
from newslake.functions import text as T
from newslake.functions import url as U
from newslake.lexicons import NEWS_EXCLUSIONS, NEWS_TAXONOMY


def _reject(rows: DataFrame, stage: str, when: Column, reason: Column) -> DataFrame:
    """Mark rows that no earlier stage rejected."""
    if "rejected_at_stage" not in rows.columns:
        rows = rows.withColumn("rejected_at_stage", F.lit(None).cast("string")).withColumn("rejection_reason", F.lit(None).cast("string"))
    new = F.col("rejected_at_stage").isNull() & F.coalesce(when, F.lit(False))
    return rows.withColumns({"rejected_at_stage": F.when(new, F.lit(stage)).otherwise(F.col("rejected_at_stage")), "rejection_reason": F.when(new, reason).otherwise(F.col("rejection_reason"))})


def normalized(observations: DataFrame, decode=T.unescaped_common) -> DataFrame:  # noqa: ANN001
    """Canonical address, clean title and summary, identity; rows without an address or title are rejected."""
    rows = observations.withColumns({
        "canonical_url": U.canonical_url(F.col("url")), "title": T.clean_headline(F.col("title"), decode), "summary": T.clean_summary(F.col("summary"), decode),
        "published_at": F.col("published_at_hint"), "discovered_at": F.col("observed_at"),
    })
    rows = rows.withColumn("article_id", T.hash_id(F.col("canonical_url")))
    return _reject(rows, "s01_normalizer", F.col("canonical_url").isNull() | F.col("title").isNull(), F.when(F.col("canonical_url").isNull(), "INVALID_URL").otherwise("INVALID_TITLE"))


def fresh(articles: DataFrame, now: Column) -> DataFrame:
    """Level and score of the age; stale articles are rejected, undated ones stay."""
    age = F.greatest(D.minutes_between(F.col("published_at"), now), F.lit(0.0))
    rows = articles.withColumn("age_minutes", F.when(F.col("published_at").isNotNull(), age))
    rows = rows.withColumn("freshness", D.level(F.col("age_minutes"))).withColumn("freshness_score", D.score(F.col("age_minutes")))
    return _reject(rows, "s02_freshness", F.col("freshness") == "stale", F.lit("STALE_CONTENT"))


def keyword_points(found: list[tuple[Column, float]], words: list[str]) -> Column:
    """Points of each of ``words``: the weight of the first field whose words (arrays) hold it."""
    none = F.lit(0.0)
    return F.array(*(F.coalesce(*(F.when(F.array_contains(own, w), weight) for own, weight in found), none) for w in words))


def relevance_columns(points: Column, excluded: Column, taxonomy: dict[str, list[str]], words: list[str]) -> dict[str, Column]:
    """Score, categories and keywords from the points of ``words`` and the first excluded word, null without one."""
    hit = {w: points[i] > 0 for i, w in enumerate(words)}
    named = lambda names, test: F.array_compact(F.array(*(F.when(test(n), F.lit(n)) for n in sorted(names))))
    categories = named(taxonomy, lambda c: reduce(or_, (hit[w] for w in taxonomy[c])))
    # (a word of two categories counts in each)
    total = reduce(add, (points[words.index(w)] for ws in taxonomy.values() for w in ws))
    score = F.when(total == 0, 0.15).otherwise(F.round(F.least(F.lit(0.95), F.lit(0.45) + total * 0.08 + F.size(categories) * 0.05), 3))
    none = F.array().cast("array<string>")
    bad = excluded.isNotNull()
    return {"relevance_score": F.when(bad, 0.10).otherwise(score), "categories": F.when(bad, none).otherwise(categories), "keywords": F.when(bad, F.array(F.concat(F.lit("exclusion:"), excluded))).otherwise(named(words, hit.get))}


def relevant(articles: DataFrame, taxonomy: dict[str, list[str]] = NEWS_TAXONOMY, exclusions: list[str] = NEWS_EXCLUSIONS, least: float = 0.40) -> DataFrame:
    """Relevance columns; rows below ``least`` are rejected.

    A field's words are a column of their own, so that each text is read once, however many words are asked for.
    """
    body = F.col("clean_text") if "clean_text" in articles.columns else F.lit("")
    tags = F.col("tags") if "tags" in articles.columns else F.array().cast("array<string>")
    words = sorted({w for ws in taxonomy.values() for w in ws})
    t, g = F.lower("title"), F.lower(F.array_join(tags, " "))
    first = F.coalesce(*(F.when(t.contains(x) | g.contains(x), F.lit(x)) for x in exclusions)) if exclusions else F.lit(None).cast("string")
    # 3 points in the title, 2 in summary or tags, 1 in the first 3000 characters of the body
    fields = [(t, 3.0), (F.lower("summary"), 2.0), (g, 2.0), (F.lower(F.substring(body, 1, 3000)), 1.0)]
    rows = articles.withColumns({f"_words{i}": T.present_words(text, words) for i, (text, _) in enumerate(fields)} | {"_excluded": first})
    rows = rows.withColumn("_points", keyword_points([(F.col(f"_words{i}"), w) for i, (_, w) in enumerate(fields)], words))
    rows = rows.withColumns(relevance_columns(F.col("_points"), F.col("_excluded"), taxonomy, words)).drop("_points", "_excluded", *(f"_words{i}" for i in range(len(fields))))
    return _reject(rows, "s03_relevance", F.col("relevance_score") < least, F.lit("LOW_RELEVANCE"))


def quality_columns(title: Column, n: Column, walled: Column, summary: Column, strict: bool = False) -> dict[str, Column]:
    """Score and reasons of the content's hygiene; ``n`` words, ``walled`` if it reads like the front of a paywall."""
    letters = F.regexp_replace(title, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    short = (n < 15) & (summary == "")
    rules = [
        ("EXTREMELY_SHORT_CONTENT", 0.45, short), ("LOW_WORD_COUNT", 0.25, ~short & (n < 30)),
        ("ALL_CAPS_HEADLINE", 0.30, (F.length(letters) >= 10) & (capitals / F.greatest(F.length(letters), F.lit(1)) > 0.70)),
        ("CLICKBAIT_HEADLINE", 0.35, T.clickbait(title)), ("PAYWALL_TRUNCATED", 0.30, walled),
    ]
    if strict:
        rules.append(("STRICT_LENGTH_REQUIREMENT_UNMET", 0.20, n < 60))
    penalty = reduce(add, (F.when(c, p).otherwise(0.0) for _, p, c in rules))
    score = F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - penalty)), 3)
    return {"quality_score": score, "quality_reasons": F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, _, c in rules)))}


def good(articles: DataFrame, strict: bool = False, least: float = 0.50, least_relevance: float = 0.40) -> DataFrame:
    """Quality columns; passing needs enough quality and relevance. Reasons stay on failure only."""
    body = F.col("clean_text") if "clean_text" in articles.columns else F.lit("")
    # what reads the whole body is a column of its own, so that it is computed once for all rules
    rows = articles.withColumns({"_n": T.word_count(F.concat(body, F.lit(" "), F.col("summary"))), "_walled": T.paywalled(body) | T.paywalled(F.col("summary"))})
    rows = rows.withColumns(quality_columns(F.col("title"), F.col("_n"), F.col("_walled"), F.col("summary"), strict)).drop("_n", "_walled")
    passed = (F.col("quality_score") >= least) & (F.col("relevance_score") >= least_relevance) if "relevance_score" in rows.columns else F.col("quality_score") >= least
    rows = rows.withColumn("is_passed", passed).withColumn("quality_reasons", F.when(F.col("is_passed"), F.array().cast("array<string>")).otherwise(F.col("quality_reasons")))
    return _reject(rows, "s04_quality", ~F.col("is_passed"), F.coalesce(F.try_element_at("quality_reasons", F.lit(1)), F.lit("LOW_RELEVANCE")))


def first_by_url(articles: DataFrame) -> DataFrame:
    """Of rows that no stage rejected, the first of each address stays."""
    from pyspark.sql import Window

    open_ = F.col("rejected_at_stage").isNull()
    place = F.row_number().over(Window.partitionBy("canonical_url", open_).orderBy("discovered_at", "id"))
    return _reject(articles.withColumn("_place", place), "s05_dedup", open_ & (F.col("_place") > 1), F.lit("EXACT_URL_DUPLICATE")).drop("_place")


def breaking_gate(published: Column, scraped: Column, now: Column) -> dict[str, Column]:
    """P5: within 30 minutes passes, within 60 softly; scraped time at half confidence; future beyond 5 minutes is refused."""
    age = D.minutes_between(F.coalesce(published, scraped), now)
    reason = F.when(age.isNull(), "no_timestamp").when(age < -5, "future_timestamp").when(age <= 30, "fresh").when(age <= 60, "soft_fresh").otherwise("too_old")
    return {"gate_age": age, "gate_confidence": F.when(published.isNotNull(), 1.0).when(scraped.isNotNull(), 0.5).otherwise(0.0), "gate_reason": reason, "gate_fresh": reason.isin("fresh", "soft_fresh")}


def legacy_verdict(title: Column, body: Column, age_hours: Column, words: list[str], max_age_hours: float = 48.0) -> Column:
    """First failing rule of spam, low quality, off topic, stale; else passed."""
    low = F.lower(F.concat_ws(" ", title, body))
    spam = T.clickbait(title) | title.rlike(r"(?i)\b(casino|viagra|lottery|free money)\b")
    return F.when(spam, "spam").when((F.length(title) < 15) | (T.word_count(body) < 20), "low_quality").when(F.size(T.matched(low, words)) == 0, "not_tech").when(age_hours > max_age_hours, "stale").otherwise("passed")


def publishable(title: Column, url: Column, summary: Column, image: Column) -> Column:
    """The first thing that is missing, or ``ok``."""
    return F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) < 15, "title_too_short").when(F.coalesce(url, F.lit("")) == "", "no_url").when(F.length(F.trim(F.coalesce(summary, F.lit("")))) < 20, "summary_too_short").when(F.coalesce(image, F.lit("")) == "", "no_image").otherwise("ok")


def valid_content(text: Column) -> Column:
    """400 characters at least; words of a paywall only in texts of 5000 and more."""
    n = F.length(F.coalesce(text, F.lit("")))
    return (n >= 400) & ((n >= 5000) | ~T.paywalled(text))


def gate(title: Column, body: Column, age_hours: Column, max_age_hours: float = 48.0, strict: bool = False) -> Column:
    """OK or a reason code; the strict gate asks for longer titles and texts."""
    n = T.word_count(body)
    standard = F.when(F.length(title) < 15, "TITLE_TOO_SHORT").when(n < 20, "TOO_FEW_WORDS").when(age_hours > max_age_hours, "TOO_OLD")
    return (standard.when(F.length(title) < 30, "TITLE_TOO_SHORT").when(n < 60, "TOO_FEW_WORDS") if strict else standard).otherwise("OK")


def is_breaking(freshness: Column, confidence: Column, importance: Column) -> Column:
    """C7."""
    return (freshness == "breaking") & (confidence >= 0.70) & (importance >= 0.60)


def published(rows: DataFrame, mode: str) -> DataFrame:
    """Column published by the run's mode: shadow and legacy runs publish nothing, active ones what passed."""
    if mode not in ("shadow", "active", "legacy"):
        raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumn("published", F.col("passed") & F.lit(mode == "active"))


def enriched(rows: DataFrame, analyst: Callable[[Any], str | None], fallback: Column) -> DataFrame:
    """Stage 9: columns note and status by a pluggable ``analyst`` of a row; its failures and empty answers take ``fallback``.

    Rows go through in Arrow batches. The analyst brings its own time limit and raises when it is over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            notes = []
            for row in batch.itertuples(index=False):
                try:
                    notes.append(analyst(row) or None)
                except Exception:  # an analyst of someone else's: any failure of it is a fallback
                    notes.append(None)
            yield batch.assign(_note=notes)

    told = rows.withColumn("_fallback", fallback).mapInPandas(run, StructType([*rows.schema.fields, StructField("_fallback", StringType()), StructField("_note", StringType())]))
    return told.select(*rows.columns, F.coalesce("_note", "_fallback").alias("note"), F.when(F.col("_note").isNull(), "fallback").otherwise("enriched").alias("status"))

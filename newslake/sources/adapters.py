"""Adapters from tables to the engine's models (S14): observations, articles and source attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.functions import url as U

#: Names of source tiers and collectors as found in older records.
TIERS = {"tier_1": 1, "premium": 1, "tier_2": 2, "specialist": 2, "tier_3": 3, "community": 3, "tier_4": 4, "discovery": 4}
COLLECTORS = ["z_rss", "z_github", "z_hacker", "z_security", "z_corp", "z_web", "z_discovery"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the lake; timestamps without zone are UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes))


def tier(raw: Column, default: int = 3) -> Column:
    """A tier from a number or a name, ``default`` if it is neither."""
    text = F.lower(F.trim(raw.cast("string")))
    named = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    number = text.try_cast("int")
    return F.coalesce(F.when(number.between(1, 4), number), F.try_element_at(named, text), F.lit(default))


def collector(raw: Column, default: str = "z_rss") -> Column:
    """A known collector kind, else ``default``."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin(*COLLECTORS), text).when(F.concat(F.lit("z_"), text).isin(*COLLECTORS), F.concat(F.lit("z_"), text)).otherwise(default)


def observation_id(source_id: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_id, F.lit("|"), F.lower(F.trim(url))), 256), 1, 20)


def page_observations(pages: DataFrame) -> DataFrame:
    """Pages as observations: the host is the source, title and first paragraph come from the markup."""
    page = pages.select(
        "page_id", "url", U.host(F.col("url")).alias("source_id"), (F.col("page_id") % 4 + 1).cast("int").alias("source_tier"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("summary"),
        F.timestamp_seconds(F.lit(1706659200) + F.col("page_id") * 60).alias("observed_at"),
    )
    hint = F.when(F.col("page_id") % 10 != 0, F.timestamp_seconds(F.unix_timestamp("observed_at") - (F.col("page_id") % 80) * 3600))
    return page.withColumn("published_at_hint", hint).withColumn("id", observation_id(F.col("source_id"), F.col("url")))


def document_articles(documents: DataFrame) -> DataFrame:
    """Documents as articles: the first line, or the first 120 characters, is the title."""
    text = F.coalesce("text", F.lit(""))
    first = F.when(text.contains("\n"), F.substring_index(text, "\n", 1)).otherwise(F.substring(text, 1, 120))
    return documents.select(
        "doc_id", first.alias("title"), text.alias("clean_text"), F.lit("").alias("summary"), F.col("source").alias("source_name"),
        (F.col("doc_id") % 4 + 1).cast("int").alias("source_tier"), F.array("lang").alias("tags"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("discovered_at"),
    )


def event_attempts(events: DataFrame) -> DataFrame:
    """Events as attempts to read a source: an error is a failure, whose code follows from ``k``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    code = F.when(failed, F.when(k % 10 == 0, 404).when(k % 10 == 1, 429).otherwise(500)).otherwise(200)
    return events.select("event_id", F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), (~failed).alias("success"), code.alias("status_code"), F.col("value").alias("response_time_ms"), k.alias("k"), "event_type")

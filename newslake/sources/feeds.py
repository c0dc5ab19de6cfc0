"""Collectors' landed records as observations (S1-S12, S15-S21): parsing and selection, no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslake.functions import dates as D

ENTRY = "struct<title:string,link:string,description:string,pubDate:string,updated:string,guid:string>"


def feed_entries(feeds: DataFrame, now: Column, first: int = 25) -> DataFrame:
    """The first entries of RSS documents (feed_id, xml): title, link, summary of 500 characters, date by fallbacks."""
    item = lambda field: F.expr(f"xpath(xml, '//item/{field}/text()')")
    items = F.expr("cast(xpath_int(xml, 'count(//item)') AS int)")
    at = F.explode(F.sequence(F.lit(1), F.least(items, F.lit(first))))
    rows = feeds.filter(items > 0).select("feed_id", "xml", at.alias("i"), F.lit(0).alias("_"))
    get = lambda field: F.try_element_at(item(field), F.col("i"))
    return rows.select("feed_id", "i", get("title").alias("title"), get("link").alias("url"), F.substring(F.coalesce(get("description"), F.lit("")), 1, 500).alias("summary"), F.coalesce(D.parsed(get("pubDate"), now), now.cast("timestamp")).alias("published_at"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(map_id, xml) to page addresses and further maps."""
    pages, more = F.expr("xpath(xml, '//url/loc/text()')"), F.expr("xpath(xml, '//sitemap/loc/text()')")
    kinds = F.array(F.struct(F.lit("page").alias("kind"), pages.alias("urls")), F.struct(F.lit("sitemap").alias("kind"), more.alias("urls")))
    return maps.select("map_id", F.explode(kinds).alias("k")).select("map_id", "k.kind", F.explode("k.urls").alias("url"))


def security_columns(text: Column) -> dict[str, Column]:
    """Distinct CVE numbers and a severity."""
    t = F.lower(text)
    severity = F.when(t.rlike("critical|zero-day|0-day|rce"), "critical").when(t.rlike("high|exploit|actively"), "high").otherwise("medium")
    return {"cves": F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(CVE-\d{4}-\d{4,7})"), F.lit(1)), F.upper)), "severity": severity, "is_primary": F.lit(True)}


def velocity_hits(polls: DataFrame, least: float = 2.0, above: float = 20.0) -> DataFrame:
    """Polls (story_id, ts, score) whose gain a minute exceeds ``least`` at a score above ``above``."""
    w = Window.partitionBy("story_id").orderBy("ts")
    gain = (F.col("score") - F.lag("score").over(w)) / ((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 60e6)
    return polls.withColumn("velocity", gain).filter((F.col("velocity") > least) & (F.col("score") > above))


def releases(repos: DataFrame, per_repo: int = 3) -> DataFrame:
    """(repo, json) with a list of releases: the first few, with a headline of repository and tag."""
    schema = "array<struct<tag:string,url:string,body:string>>"
    each = repos.select("repo", F.posexplode(F.slice(F.from_json("json", schema), 1, per_repo)).alias("i", "r"))
    return each.select("repo", "i", F.concat("repo", F.lit(" "), F.col("r.tag"), F.lit(" released")).alias("title"), F.col("r.url").alias("url"))


def advisories(rows: DataFrame, first: int = 10) -> DataFrame:
    """Advisories of high and critical severity among the first few of each repository."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("pos"))
    return rows.withColumn("_p", place).filter((F.col("_p") <= first) & F.lower("severity").isin("high", "critical")).drop("_p")


def google_entry(title: Column, link: Column) -> dict[str, Column]:
    """The address inside a redirect, and the source after the last " - " of the title."""
    inner = F.regexp_extract(link, r"[?&]url=([^&]+)", 1)
    return {"url": F.when(inner != "", F.try_url_decode(inner)).otherwise(link), "title": F.when(title.contains(" - "), F.regexp_extract(title, r"^(.*) - [^-]*$", 1)).otherwise(title), "source": F.regexp_extract(title, r"^.* - ([^-]*)$", 1)}


def bing_articles(rows: DataFrame) -> DataFrame:
    """Nested provider and thumbnail of Bing items in a JSON column."""
    j = F.from_json("json", "name string, url string, provider array<struct<name:string>>, image struct<thumbnail:struct<contentUrl:string>>, datePublished string")
    return rows.select("*", j.alias("j")).select(*rows.columns, F.col("j.name").alias("title"), F.col("j.url").alias("url"), F.coalesce(F.try_element_at("j.provider.name", F.lit(1)), F.lit("Bing")).alias("source"), F.col("j.image.thumbnail.contentUrl").alias("image_url"))


def reddit_posts(rows: DataFrame, least: int = 10) -> DataFrame:
    """Posts of a score that are neither self nor sticky."""
    return rows.filter((F.col("score") >= least) & ~F.coalesce("is_self", F.lit(False)) & ~F.coalesce("stickied", F.lit(False)))


def rotation_weights(rows: DataFrame) -> DataFrame:
    """Each region's chance: its priority over the sum."""
    total = rows.agg(F.sum("priority").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("priority") / F.col("total")).drop("total")  # one row


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry CSV; rows that do not parse are left out."""
    return spark.read.schema("elapsed_seconds double, rss_mb double, vms_mb double, cpu_percent double, num_fds int").option("header", True).option("mode", "DROPMALFORMED").csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The JSON registry of sources in order of tier and name."""
    return spark.read.schema("id string, name string, url string, tier int, kind string").json(path).orderBy("tier", "name")


def corporate_entries(feeds: DataFrame, now: Column) -> DataFrame:
    """S3: a company's feed: as S1, of the first tier and primary."""
    return feed_entries(feeds, now).withColumns({"source_tier": F.lit(1), "is_primary": F.lit(True)})


#: Fields of the interfaces' records.
RECORDS = {
    "newsapi": "title string, url string, description string, publishedAt string, source struct<name:string>",
    "duckduckgo": "title string, href string, body string",
    "x": "text string, id string, author struct<username:string>",
}


def adapted(rows: DataFrame, kind: str) -> DataFrame:
    """Title, url and source of records of an interface in a JSON column, beside the other columns."""
    j = lambda path: F.col(f"j.{path}")
    shapes = {
        "newsapi": (j("title"), j("url"), F.coalesce(j("source.name"), F.lit("NewsAPI"))),
        "duckduckgo": (j("title"), j("href"), F.lit("DuckDuckGo")),
        "x": (F.substring_index(j("text"), "\n", 1), j("id"), F.concat(F.lit("@"), j("author.username"))),
    }
    parsed = rows.withColumn("j", F.from_json("json", RECORDS[kind]))
    title, url, source = shapes[kind]
    return parsed.select(*(c for c in rows.columns if c != "json"), title.alias("title"), url.alias("url"), source.alias("source"))


def database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of ``key``; needs a driver on the class path."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)

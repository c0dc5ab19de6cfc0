"""URL filters: rules first, then trust and distrust propagated over the graph of hosts, in DataFrame functions alone.

Rules (host, path) allow or block a host with its subdomains below a path; the longest that fits decides. Urls that no
rule fits get their host's verdict. Trust is a personalised PageRank: it starts at hosts in proportion to the share of their
pages that a rule allows and follows links. Distrust starts likewise at blocked pages and follows links backwards, as who links to
a bad host is suspect. Both are kept unnormalised, on one scale, so a verdict compares one host's values and no
total: a host is blocked when its distrust is more than ``THRESHOLD`` of both. Hosts that neither reaches are allowed.

Edges are the distinct pairs of hosts in links with an address of their own, counted once a page; links within a host and relative ones are
none. They are aggregated before anything else, so that a host with a third of all pages is one row an edge. A
round joins the scores with the edges by host and sums by target (combined before the shuffle); adaptive plans split a hub's edges.
What leaks at hosts without links only scales the restart, and is left out. Each round is written to the shared
folder; rounds end when no score moves by more than ``TOLERANCE``, by the damping after ``ROUNDS`` at the latest.

A null url or one without ``://`` has an empty host and path, fits no rule and is allowed; its links count for nothing.
Null and empty html have no links; very long pages are matched whole in the JVM. Repeated rows each return and count as
pages. An empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.lake import forgotten, written

#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 20, 1e-9, 0.5
LINK = r"""<[Aa]\s[^<>]*?[Hh][Rr][Ee][Ff]\s*=\s*["']?\s*([Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null where none does. ``rules`` is short, as it is part of the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, weight: pages of a host that link to another. ``pages``: host and html."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(2)), lambda h: F.translate(h, UPPER, LOWER)))
    each = pages.filter("host != '' AND html IS NOT NULL").select(F.col("host").alias("source"), F.explode(linked).alias("target"))
    return each.filter("source != target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host and score: a walk from ``seeds`` (host, seed) along ``edges`` (source, target, share), that restarts with 1 - ``damping``."""
    restart = seeds.filter("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("score"))
    scores = written(restart)
    for _ in range(rounds):
        moved = scores.join(edges, scores["host"] == edges["source"]).select(F.col("target").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("was"))
        first = restart.select("host", "score", F.lit(0.0).alias("was"))
        was = scores.select("host", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        both = written(moved.unionByName(first).unionByName(was).groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")))
        forgotten(scores)
        scores = both
        change = both.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if change <= tolerance:
            break
    return scores.select("host", "score")


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, n_pages of every host that has a page or is linked. ``pages``: url and html."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    verdict = ruled(F.col("host"), F.col("path"), rules)["verdict"]
    share = lambda v: (F.count_if(verdict == v) / F.count("*")).alias(v)
    hosts = written(hosted.filter("host != ''").groupBy("host").agg(share("allow"), share("block"), F.count("*").alias("n_pages")))
    edges = written(host_edges(hosted))
    out = written(edges.groupBy("source").agg(F.sum("weight").alias("of")))
    into = written(edges.groupBy("target").agg(F.sum("weight").alias("of")))
    ahead = written(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("of")).alias("share")))
    back = written(edges.join(into, "target").select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("weight") / F.col("of")).alias("share")))
    trust = propagated(ahead, hosts.select("host", F.col("allow").alias("seed")), damping, rounds)
    distrust = propagated(back, hosts.select("host", F.col("block").alias("seed")), damping, rounds)
    zero = F.lit(0.0)
    parts = trust.select("host", F.col("score").alias("trust"), zero.alias("distrust"), F.lit(0).cast("bigint").alias("n_pages"))
    parts = parts.unionByName(distrust.select("host", zero.alias("trust"), F.col("score").alias("distrust"), F.lit(0).cast("bigint").alias("n_pages")))
    parts = parts.unionByName(hosts.select("host", zero.alias("trust"), zero.alias("distrust"), "n_pages"))
    return parts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.sum("n_pages").alias("n_pages"))


def filtered_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    scores = host_scores(pages, rules, damping, rounds)
    blocked = written(scores.filter(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("bad")))
    judged = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fits", ruled(F.col("host"), F.col("path"), rules)).join(blocked, F.col("host") == F.col("bad"), "left")
    own = F.when(F.col("bad").isNull(), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", own).alias("verdict"))


def oracle(table: str = "pages", rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """``filtered_urls`` as DuckDB SQL, with all rounds."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}) THEN" for _, h, p in longest]
    rule = "CASE " + " ".join(f"{f} {q(h + p)}" for f, (_, h, p) in zip(fits, longest)) + " END"
    verdict = "CASE " + " ".join(f"{f} {q(v)}" for f, (v, _, _) in zip(fits, longest)) + " END"
    low = lambda x: f"translate({x}, {q(UPPER)}, {q(LOWER)})"
    walks = ""
    for kind, seed, a, b in (("t", "allow", "source", "target"), ("d", "block", "target", "source")):
        walks += f", s{kind} AS MATERIALIZED (SELECT host, {1 - damping!r} * {seed} AS score FROM hosts WHERE {seed} > 0), o{kind} AS MATERIALIZED (SELECT {a} AS source, {b} AS target, weight / sum(weight) OVER (PARTITION BY {a}) AS share FROM edges), {kind}0 AS MATERIALIZED (SELECT * FROM s{kind})"
        for k in range(rounds):
            walks += f", {kind}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT target AS host, {damping!r} * score * share AS score FROM {kind}{k} JOIN o{kind} ON host = source UNION ALL SELECT * FROM s{kind}) GROUP BY host)"
    return f"""
WITH d AS MATERIALIZED (SELECT page_id, {low("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM {table}),
r AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS ruled FROM d),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS allow, count(*) FILTER (ruled = 'block') / count(*) AS block FROM r WHERE host <> '' GROUP BY host),
links AS (SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(html, {q(LINK)}, 2), lambda x: {low('x')}))) AS target FROM d WHERE host <> '' AND html IS NOT NULL),
edges AS MATERIALIZED (SELECT source, target, count(*) AS weight FROM links WHERE source <> target GROUP BY ALL){walks}
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) > {threshold!r} * (coalesce(t.score, 0) + coalesce(d.score, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t{rounds} AS t ON t.host = r.host LEFT JOIN d{rounds} AS d ON d.host = r.host"""

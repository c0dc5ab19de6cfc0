"""HTML operators (H1-H7, S6, S7): stdlib parsing in Arrow batches, scoring in SQL."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.lexicons import ASIDE, FILES, NO_PAGES, SECTIONS

#: Elements without text of their own to read.
BOILERPLATE = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe", "svg"}
CONTAINERS = ["article", "main", "body"]
#: Patterns over our own lists: links that are left out, and addresses that look like an article's (a section, a date, a long number or a title of four words).
SKIPPED = rf"(?i)(^#|^({'|'.join(NO_PAGES)}):|(^|/)({'|'.join(ASIDE)})(/|$)|\.({'|'.join(FILES)})$)"
ARTICLE = rf"(?i)(/({'|'.join(SECTIONS)})/|/(19|20)\d\d[/-]\d\d?[/-]|/\d{{6,}}|/\w+-\w+-\w+-\w+)"


class _Text(HTMLParser):
    """Text by container, paragraphs and links, without boilerplate."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.held: dict[str, list[str]] = {c: [] for c in CONTAINERS}
        self.paragraphs: list[list[str]] = []
        self.links: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        self.open.append(tag)
        if tag == "p":
            self.paragraphs.append([])
        if tag == "a":
            self.links.append((dict(attrs).get("href") or "", []))

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if "a" in self.open and self.links:
            self.links[-1][1].append(data)
        if BOILERPLATE.intersection(self.open):
            return
        for c in CONTAINERS:
            if c in self.open:
                self.held[c].append(data)
        if "p" in self.open and self.paragraphs:
            self.paragraphs[-1].append(data)


def _read(source: str | None) -> _Text:
    p = _Text()
    p.feed(source or "")
    p.close()
    return p


def _line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def container_text(source: str | None, least: int = 200) -> str:
    """H1, H2: text of the first container with over ``least`` characters, else the paragraphs of over 50."""
    p = _read(source)
    for c in CONTAINERS:
        text = _line(p.held[c])
        if len(text) > least:
            return text
    return "\n".join(t for t in map(_line, p.paragraphs) if len(t) > 50)


def html_texts(pages: DataFrame) -> DataFrame:
    """H1, H2, H7: page_id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "text": [container_text(h) for h in b.html]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string")


def html_links(pages: DataFrame) -> DataFrame:
    """H4: raw links: page_id, url, position, href, anchor text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, u, k, href, _line(text)) for i, u, h in zip(b.page_id, b.url, b.html) for k, (href, text) in enumerate(_read(h).links)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "pos", "href", "anchor"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, pos int, href string, anchor string")


def absolute(page: Column, href: Column) -> Column:
    """An address without query and fragment, from the page's own."""
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    h = F.regexp_replace(F.trim(href), r"[?#].*$", "")
    return F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), h))


def scored_links(links: DataFrame, skipped: str = SKIPPED, article: str = ARTICLE) -> DataFrame:
    """Absolute distinct links of a page with internal and article flags and a score up to one."""
    from newslake.functions import url as U

    rows = links.filter(~F.col("href").rlike(skipped) & (F.trim("href") != "")).withColumn("target", absolute(F.col("url"), F.col("href")))
    rows = rows.groupBy("page_id", "url", "target").agg(F.max_by("anchor", F.struct(F.length("anchor"), "anchor")).alias("anchor"))
    words = F.size(F.filter(F.split("anchor", r"\s+"), lambda w: w != ""))
    is_article = F.col("target").rlike(article) | (words >= 5)
    internal = U.domain(F.col("target")) == U.domain(F.col("url"))
    score = F.when(F.col("target").rlike(article), 0.5).otherwise(0.0) + F.least(words / 10 * 0.3, F.lit(0.3)) + F.when(internal, 0.2).otherwise(0.0)
    return rows.select("page_id", "target", "anchor", internal.alias("internal"), is_article.alias("article"), F.round(score, 6).alias("score"))


def meta_columns(source: Column) -> dict[str, Column]:
    """H3: title (og, h1, title), description, language and keywords of a page, by patterns inside the JVM."""
    attr = lambda name: F.regexp_extract(source, rf'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1)
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract(source, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1), "<[^>]+>", " "))
    some = lambda *xs: F.coalesce(*(F.when(x != "", x) for x in xs))
    return {"title": some(attr("og:title"), tag("h1"), tag("title")), "description": some(attr("description"), attr("og:description")), "lang": some(F.regexp_extract(source, r'(?i)<html[^>]*lang="([^"]*)"', 1)), "image": some(attr("og:image"))}


def json_ld_date(source: Column) -> Column:
    """H3: the published date in a page's JSON-LD."""
    return F.get_json_object(F.regexp_extract(source, r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), "$.datePublished")


def unescape(text: str) -> str:
    return html.unescape(re.sub("<[^>]+>", " ", text))

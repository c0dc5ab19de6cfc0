"""Page operators over a tree of elements: listings (S6, S7), deep extraction (H2), links in context (H5), blocks (H7).

A page is parsed once into arrays; each operator is a short function over them, run in Arrow batches.
Null pages are empty. Selectors, patterns and bounds are parameters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.lexicons import PAYWALL
from newslake.sources.markup import BOILERPLATE

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4"}
SELECTORS = ["article", "main", ".article-body", ".post-content", ".entry-content"]
BLOCKS = {"div", "section", "article", "main", "td", "body"}
TEXT_KEYS = {"articleBody", "body", "content", "text"}


class Tree(HTMLParser):
    """Elements in page order: parent, tag, names (class words and id), attributes, last descendant; and the runs of text."""

    def __init__(self, source: str | None):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.attrs, self.last = [-1], ["#root"], [set()], [{}], [0]
        self.runs: list[tuple[int, str]] = []
        self.span = [[0, 0]]  # runs of text within each element
        self._open, self._count = [0], {"#root": 1}
        self.feed(source or "")
        self.close()
        for i in self._open:
            self.span[i][1] = len(self.runs)
        for i in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.names.append({*(own.get("class") or "").split(), own.get("id") or ""} - {""})
        self.attrs.append(own)
        self.last.append(len(self.tag) - 1)
        self.span.append([len(self.runs), len(self.runs)])
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self._count.get(tag):
            while True:
                i = self._open.pop()
                self.span[i][1], shut = len(self.runs), self.tag[i]
                self._count[shut] -= 1
                if shut == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.runs.append((self._open[-1], data))

    def up(self, i: int) -> Iterator[int]:
        """Ancestors of an element, nearest first."""
        while self.parent[i] >= 0:
            i = self.parent[i]
            yield i

    def inside(self, tags: set[str]) -> list[bool]:
        """Whether each element is one of ``tags`` or below one."""
        out = []
        for i, tag in enumerate(self.tag):
            out.append(tag in tags or i > 0 and out[self.parent[i]])
        return out

    def text(self, i: int, without: list[bool] | None = None) -> str:
        """Squeezed text of an element and what is below it."""
        return " ".join(" ".join(t for n, t in self.runs[slice(*self.span[i])] if not (without and without[n])).split())

    def found(self, selector: str) -> list[int]:
        """Elements of a selector: a tag, ``.class``, ``#id`` or a tag with either."""
        tag, _, name = re.sub("[#.]", " ", selector, count=1).partition(" ")
        return [i for i in range(1, len(self.tag)) if (not tag or self.tag[i] == tag) and (not name or name in self.names[i])]


def listing(tree: Tree, most: int = 30) -> list[tuple[str, str]]:
    """(address, title) of a page that lists articles.

    Links in headings or articles outside boilerplate, or else links whose text has 20 to 150 characters and more
    than three words; titles of five words and more; the first of an address; at most ``most``.
    """
    off, linked = tree.inside(BOILERPLATE), tree.inside(HEADINGS | {"article"})
    links = [(i, tree.attrs[i]["href"], tree.text(i)) for i in range(1, len(tree.tag)) if tree.tag[i] == "a" and tree.attrs[i].get("href") and not off[i]]
    chosen = [x for x in links if linked[x[0]]] or [x for x in links if 20 <= len(x[2]) <= 150 and len(x[2].split()) > 3]
    out: dict[str, str] = {}
    for _, href, title in chosen:
        if len(title.split()) >= 5:
            out.setdefault(href, title)
    return list(out.items())[:most]


def headlines(tree: Tree, selectors: list[str]) -> list[tuple[str, str]]:
    """(address, title) by the first of ``selectors`` that finds any; the address is of the link in or around it."""
    for selector in selectors:
        out = []
        for i in tree.found(selector):
            inner = [k for k in range(i, tree.last[i] + 1) if tree.tag[k] == "a"] + [k for k in tree.up(i) if tree.tag[k] == "a"]
            if title := tree.text(i):
                out.append((tree.attrs[inner[0]].get("href") or "" if inner else "", title))
        if out:
            return out
    return []


def deep_text(tree: Tree, selectors: list[str] = SELECTORS, least: int = 200, paywall: list[str] = PAYWALL) -> tuple[str, str]:
    """H2: (method, text): the first selected element of over ``least`` characters, else the paragraphs of the element that
    has most of them, else all paragraphs of over 50; a text under 400 characters with words of a paywall is blank."""
    off = tree.inside(BOILERPLATE)
    method, text = "", ""
    for selector in selectors:
        text = next((t for t in (tree.text(i, off) for i in tree.found(selector)) if len(t) > least), "")
        if text:
            method = "selector"
            break
    paragraphs = [i for i in range(1, len(tree.tag)) if tree.tag[i] == "p" and not off[i]]
    if not text and paragraphs:
        under: dict[int, list[int]] = {}
        for i in paragraphs:
            under.setdefault(tree.parent[i], []).append(i)
        dense = max(under.values(), key=lambda own: (len(own), -own[0]))
        text = "\n".join(filter(None, map(tree.text, dense)))
        method = "density"
        if len(text) <= least:
            text, method = "\n".join(t for t in map(tree.text, paragraphs) if len(t) > 50), "paragraphs"
    if len(text) < 400 and any(re.search(p, text, re.I) for p in paywall):
        return "paywall", ""
    return (method, text) if text else ("", "")


URL_SIGNS = [r"/\d{4}/\d{1,2}/", r"/(article|news|story|post|blog)/", r"\d{5,}", r"-[a-z]+-[a-z]+-"]


def context_links(tree: Tree, above: float = 0.3) -> list[tuple[str, str, float]]:
    """H5: (address, anchor, score) of links that score over ``above``: 0.2 for each sign in the address, for an anchor of four
    words, for a parent with as many words more, and for an article or main around it; at most one."""
    off, held = tree.inside(BOILERPLATE), tree.inside({"article", "main"})
    out = []
    for i in range(1, len(tree.tag)):
        if tree.tag[i] != "a" or not tree.attrs[i].get("href") or off[i]:
            continue
        href, anchor = tree.attrs[i]["href"], tree.text(i)
        around = len(tree.text(tree.parent[i]).split()) - len(anchor.split())
        signs = sum(bool(re.search(p, href, re.I)) for p in URL_SIGNS) + (len(anchor.split()) >= 4) + (around >= 4) + held[i]
        if signs * 0.2 > above:
            out.append((href, anchor, round(min(1.0, signs * 0.2), 6)))
    return out


def largest_block(tree: Tree) -> str:
    """H7: the text of the block element whose own text (of its runs, paragraphs and headings, not of blocks in it) is longest."""
    off, own = tree.inside(BOILERPLATE), {}
    for n, t in tree.runs:
        if not off[n] and t.strip():
            at = n if tree.tag[n] in BLOCKS else next((k for k in tree.up(n) if tree.tag[k] in BLOCKS), 0)
            own.setdefault(at, []).append(t)
    texts = {k: " ".join(" ".join(v).split()) for k, v in own.items()}
    return max(texts.items(), key=lambda kv: (len(kv[1]), -kv[0]))[1] if texts else ""


def json_text(tree: Tree, keys: set[str] = TEXT_KEYS) -> str:
    """H7: the longest string under one of ``keys`` in the page's JSON scripts."""
    best = ""

    def look(x: object, named: bool) -> None:
        nonlocal best
        if isinstance(x, dict):
            for k, v in x.items():
                look(v, k in keys)
        elif isinstance(x, list):
            for v in x:
                look(v, named)
        elif isinstance(x, str) and named and len(x) > len(best):
            best = x

    for i in range(1, len(tree.tag)):
        if tree.tag[i] == "script" and "json" in (tree.attrs[i].get("type") or ""):
            try:
                look(json.loads(" ".join(t for n, t in tree.runs if n == i)), False)
            except ValueError:
                continue
    return best


def each(pages: DataFrame, read: Callable[[Tree], list[tuple]], fields: str) -> DataFrame:
    """Rows (page_id, pos, *fields) of what ``read`` finds in each page's ``html``."""
    names = ["page_id", "pos", *(f.strip().split(" ")[0] for f in fields.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, k, *row) for i, h in zip(b.page_id, b.html) for k, row in enumerate(read(Tree(h)))], columns=names)

    return pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string")).mapInPandas(run, f"page_id bigint, pos int, {fields}")


def listed(pages: DataFrame) -> DataFrame:
    """S6."""
    return each(pages, listing, "href string, title string")


def directory(pages: DataFrame, selectors: list[str]) -> DataFrame:
    """S7."""
    return each(pages, lambda tree: headlines(tree, selectors), "href string, title string")


def deep_texts(pages: DataFrame) -> DataFrame:
    """H2."""
    return each(pages, lambda tree: [deep_text(tree)], "method string, text string").drop("pos")


def linked_in_context(pages: DataFrame) -> DataFrame:
    """H5."""
    return each(pages, context_links, "href string, anchor string, score double")


def blocks(pages: DataFrame) -> DataFrame:
    """H7."""
    return each(pages, lambda tree: [(largest_block(tree), json_text(tree))], "block string, json string").drop("pos")

"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Nodes are block elements and the runs of text directly inside them. A node is *on* if it holds main
text. Each node has a potential from its features and each parent-child pair has one by the kind of edge.
A block's features are its tag, class and id words, and what it holds: its words, the share of them in links, how
many runs of prose and which part of the page's prose. A text's are its length, link share, punctuation, parent,
the texts before and after it and words that announce what is not the article. On a tree
sum-product is exact: messages go up from the deepest nodes, then down, and give every node's marginal.
Weights follow the gradient of the likelihood of labelled pages, observed minus expected counts, with
the expectations from the same messages. The text of a page is that of its text runs whose marginal is
at least one half, in page order.

Labelled pages are a bounded training set: a list of (html, main texts). ``labelled_pages`` writes
some from invented words over many page layouts, half of them without names that mean anything; pass others for
other sites. Features that fewer than ``RARE`` of them have are left out, so that the names of one page are not learned.

Null and empty pages give the empty text. Broken markup is closed as browsers do in the common cases. Very long
and very deep pages take time in proportion to their size; a page's tree is in memory at once. Texts on the edge
of one half are kept. Repeated rows each return; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import groups_of, texts_of

#: HTML element classes.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript title textarea svg math iframe object select xmp noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
PARAGRAPH_KEEPS = set("button td th table caption object".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Words that announce what is not the article, in short texts.
CUES = set("""
abonnieren abonnez acepto accept advert advertisement also anzeige auch aussi also click comments commentaires comentarios consent
cookies cookie copyright datenschutz follow impressum kommentare newsletter partager popular privacy publicidad publicite read recommended
related reply reserved rights share sign sponsored subscribe suscribete tags teilen terms trending werbung
""".split())
#: Words in the names of blocks that hold something else, or the article.
APART = set("""
ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion
footer gdpr header legal logo masthead menu modal nav navbar navigation newsletter notice overlay pagination paywall popular popup promo
promotion recirc recommended related replies reply responses secondary share sharing sidebar signup social sponsor sponsored subscribe
taboola tags teaser teasers toolbar topbar trending warning widget
""".split())
MAIN = set("article body content entry main post story text".split())
WORD = re.compile(r"[^\W\d_]+")
RARE = 3


def _step(x: float, *bounds: float) -> int:
    return bisect.bisect_right(bounds, x)


class Page:
    """Nodes of a page in page order: parent, tag, names, and for text runs the text and the length of its links."""

    __slots__ = ("parent", "tag", "names", "text", "linked")

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.text, self.linked = [-1], ["#root"], [()], [None], [0]
        stack, tags = [0], ["#root"]
        places: dict[str, list[int]] = {"#root": [0]}  # where in the stack each open tag stands
        unclosed: set[str] = set()
        held: list[str] = []
        link = linked = at = 0

        def flush() -> None:
            nonlocal linked
            if held:
                run = " ".join(entities.unescape("".join(held)).split())
                if run:
                    self._add(stack[-1], "#text", (), run, linked)
                held.clear()
            linked = 0

        def say(raw: str) -> None:
            nonlocal linked
            held.append(raw)
            if link:
                linked += len(raw)

        def pop_to(k: int) -> None:
            nonlocal link
            flush()
            link = 0
            for shut in tags[k:]:
                places[shut].pop()
            del stack[k:], tags[k:]

        def last(names: set[str] | tuple, before: int) -> int:
            """Place of the innermost open tag of ``names`` before a place, or -1."""
            found = -1
            for x in names:
                own = places.get(x)
                if own:
                    i = bisect.bisect_left(own, before)
                    found = max(found, own[i - 1] if i else -1)
            return found

        while m := TOKEN.search(source, at):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    say(entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1] in ("!", "?"):
                continue
            tag = m[2].lower()
            if m[1] == "/":
                if tag == "a":
                    link = 0
                elif tag not in INLINE and places.get(tag):
                    pop_to(places[tag][-1])
                continue
            if tag in INLINE:
                if tag == "br":
                    held.append(" ")
                elif tag == "a":
                    link = 1
                continue
            # a block: close what it cannot stand in
            k = len(tags)
            if places.get("p") and last(PARAGRAPH_KEEPS, k) < places["p"][-1]:
                k = places["p"][-1]
            if shut := CLOSES.get(tag):
                stop = last(BARRIER.get(tag, ()), k)
                for x in shut:
                    own = places.get(x, [])
                    i = bisect.bisect_right(own, stop)
                    if i < len(own):
                        k = min(k, own[i])
            if k < len(tags):
                pop_to(k)
            flush()
            if tag in RAW:
                end = None if tag in unclosed else END[tag].search(source, at)
                if not end:
                    unclosed.add(tag)  # not looked for again
                if end or tag != "select":
                    at = end.end() if end else len(source)
                if m[3].rstrip().endswith("/") and tag in ("svg", "math", "iframe", "object"):
                    at = m.end()
                continue
            names: tuple[str, ...] = ()
            if len(m[3]) > 3:
                names = tuple(dict.fromkeys(w.lower() for a in ATTRIBUTE.finditer(m[3]) for w in NAME_WORDS.findall(a[2])))
                if HIDDEN.search(m[3]):
                    names += ("#hidden",)
            i = self._add(stack[-1], tag, names, None, 0)
            if tag not in VOID and not (tag in ("svg", "math") and m[3].endswith("/")):
                places.setdefault(tag, []).append(len(tags))
                stack.append(i)
                tags.append(tag)
        if at < len(source):
            say(source[at:])
        flush()

    def _add(self, parent: int, tag: str, names: tuple[str, ...], text: str | None, linked: int) -> int:
        for column, x in zip((self.parent, self.tag, self.names, self.text, self.linked), (parent, tag, names, text, linked)):
            column.append(x)
        return len(self.tag) - 1

    def features(self) -> list[list[str]]:
        """Names of the features of each node, in time in proportion to the nodes."""
        n = len(self.tag)
        words, chars, linked, prose = [0] * n, [0] * n, list(self.linked), [0] * n
        runs = [i for i in range(n) if self.text[i] is not None]
        for i in runs:
            text = self.text[i]
            words[i], chars[i] = text.count(" ") + 1, len(text)
            prose[i] = int(words[i] >= 10 and linked[i] < 0.3 * chars[i])
        own = {i: _step(words[i], 4, 10, 25) for i in runs}
        total = [0] * n  # words of prose below a node
        for i in runs:
            total[i] = words[i] * prose[i]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            words[up] += words[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            prose[up] += prose[i]
            total[up] += total[i]
        all_prose = max(1, total[0])
        out: list[list[str]] = []
        for i in range(n):
            share = _step(linked[i] / max(1, chars[i]), 0.1, 0.6)
            if self.text[i] is None:
                tag = self.tag[i]
                found = [f"tag={tag}", *(f"name={x}" for x in self.names[i])]
                kind = "apart" if APART.intersection(self.names[i]) else "main" if MAIN.intersection(self.names[i]) else ""
                if kind:
                    found += [f"kind={kind}", f"kind={kind},prose={int(prose[i] > 0)}", f"kind={kind},part={_step(total[i] / all_prose, 0.05, 0.3, 0.7)}"]
                if self.parent[i] >= 0:
                    found.append(f"tag={tag}<{self.tag[self.parent[i]]}")
                held, part = _step(prose[i], 1, 2, 5), _step(total[i] / all_prose, 0.05, 0.3, 0.7)
                found += [f"holds={_step(words[i], 1, 6, 20, 80)},{share}", f"prose={held},{share}", f"part={part}", f"tag={tag},part={part}"]
                out.append(found)
            else:
                part = _step(total[i] / all_prose, 0.05, 0.3, 0.7)
                out.append([f"text<{self.tag[self.parent[i]]}", f"size={own[i]},part={part}", f"size={own[i]}", f"link={share}", f"stop={int(self.text[i][-1] in '.!?…')}", f"size={own[i]},link={share == 2}"])
        for k, i in enumerate(runs):
            before = own[runs[k - 1]] if k else -1
            after = own[runs[k + 1]] if k + 1 < len(runs) else -1
            out[i] += [f"size={own[i]},before={before}", f"size={own[i]},after={after}"]
            if own[i] < 3 and self.tag[self.parent[i]] != "p":  # paragraphs of an article may say the same
                out[i] += [f"cue={x}" for x in CUES.intersection(WORD.findall(self.text[i].lower()))]
            if "©" in self.text[i]:
                out[i].append("cue=©")
        return out


EDGES = 4


def _edge(page: Page, i: int) -> int:
    """Kind of the edge from the parent: to text or to an element, from a wrapper or from another block."""
    wide = page.tag[page.parent[i]] in ("#root", "html", "body", "div", "main", "section", "article", "center", "td", "tr", "table", "tbody")
    return 2 * (page.text[i] is not None) + wide


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Forest:
    """Nodes of several pages as arrays, by depth."""

    def __init__(self, pages: list[Page], index: dict[str, int], grow: bool = False):
        parent, edge, depth, node, feature = [], [], [], [], []
        self.first = [0]
        for page in pages:
            base = self.first[-1]
            for i, (up, names) in enumerate(zip(page.parent, page.features())):
                parent.append(base + up if up >= 0 else -1)
                depth.append(depth[base + up] + 1 if up >= 0 else 0)
                edge.append(_edge(page, i) if up >= 0 else 0)
                for name in names:
                    f = index.setdefault(name, len(index)) if grow else index.get(name, -1)
                    if f >= 0:
                        node.append(base + i)
                        feature.append(f)
            self.first.append(base + len(page.parent))
        self.n = self.first[-1]
        self.parent, self.edge = np.array(parent, np.int64), np.array(edge, np.int64)
        self.node, self.feature = np.array(node, np.int64), np.array(feature, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each node is on, and of (parent, child) states of each edge, by sum-product."""
        belief = np.zeros((self.n, 2))
        belief[:, 1] = np.bincount(self.node, weights[self.feature], self.n)
        message = np.zeros((self.n, 2))
        for own in reversed(self.levels):
            if len(own) == 1:  # the lone nodes of deep pages: numpy's calls cost more than the sums
                i = int(own[0])
                (a, b), (c, d) = pairs[self.edge[i]].tolist()
                off, on = belief[i].tolist()
                message[i] = _log_sum(a + off, b + on), _log_sum(c + off, d + on)
                belief[self.parent[i]] += message[i]
                continue
            both = pairs[self.edge[own]] + belief[own][:, None, :]
            message[own] = np.logaddexp(both[..., 0], both[..., 1])
            np.add.at(belief, self.parent[own], message[own])
        joint = np.zeros((self.n, 2, 2))
        for own in self.levels:
            if len(own) == 1:
                own = slice(int(own[0]), int(own[0]) + 1)
            cavity = belief[self.parent[own]] - message[own]
            both = pairs[self.edge[own]] + cavity[:, :, None]
            joint[own] = both + belief[own][:, None, :]
            belief[own] += np.logaddexp(both[:, 0], both[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint / joint.sum(axis=(1, 2), keepdims=True)


class Model:
    """Weights by feature name and potentials by kind of edge."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, pairs

    def extract(self, sources: list[str]) -> list[str]:
        out: list[str] = []
        for i, j in groups_of([len(x) for x in sources], 1 << 20):
            pages = [Page(x) for x in sources[i:j]]
            forest = Forest(pages, self.index)
            on, _ = forest.marginals(self.weights, self.pairs)
            for page, base in zip(pages, forest.first):
                out.append("\n".join(t for k, t in enumerate(page.text) if t is not None and on[base + k] >= 0.5))
        return out


def fit(labelled: list[tuple[str, list[str]]], rounds: int = 200, rate: float = 1.0, decay: float = 3e-5) -> Model:
    """Weights by gradient ascent (with momentum by coordinate) on the likelihood of ``labelled`` pages."""
    pages, truth = [Page(source) for source, _ in labelled], []
    on_pages = Counter(name for page in pages for name in {x for names in page.features() for x in names})
    index = {name: k for k, name in enumerate(x for x, n in on_pages.items() if n >= RARE)}
    for page, (_, texts) in zip(pages, labelled):
        wanted = {" ".join(t.split()) for t in texts}
        on = np.array([t is not None and t in wanted for t in page.text])
        for i in range(len(on) - 1, 0, -1):
            on[page.parent[i]] |= on[i]
        truth.append(on)
    forest, on = Forest(pages, index), np.concatenate(truth).astype(float)
    weights, pairs = np.zeros(len(index)), np.zeros((EDGES, 2, 2))
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[inner], on[forest.parent[inner]].astype(int), on[inner].astype(int)), 1)
    target = np.bincount(forest.feature, on[forest.node], len(index))
    scale_w, scale_p = np.full(len(index), 1e-8), np.full(pairs.shape, 1e-8)
    for _ in range(rounds):
        p, joint = forest.marginals(weights, pairs)
        slope = target - np.bincount(forest.feature, p[forest.node], len(index)) - decay * len(pages) * weights
        expected = np.zeros(pairs.shape)
        np.add.at(expected, forest.edge[inner], joint[inner])
        slope_p = seen - expected - decay * len(pages) * pairs
        scale_w += slope**2
        scale_p += slope_p**2
        weights += rate * slope / np.sqrt(scale_w)
        pairs += rate * slope_p / np.sqrt(scale_p)
    return Model(index, weights, pairs)


def labelled_pages(n: int = 1200, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Invented pages of many layouts with their main texts."""
    rng = random.Random(seed)
    parts = "ka lo mi ran tes vol dor en ist ung ble que ona reu sti ver pal nor ez gri".split()
    word = lambda: "".join(rng.choices(parts, k=rng.choice((1, 2, 2, 3))))
    run = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pick = rng.choice

    def sentence(a: int = 3, b: int = 22) -> str:
        return run(a, b).capitalize() + pick(("", "", ",")) + " " + run(1, 6) + pick("....!?")

    def prose() -> str:
        return " ".join(sentence() for _ in range(pick((1, 1, 1, 2, 3, 5, 9))))

    def short() -> str:
        return run(1, 6)

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{pick((word(), run(1, 5)))}</a></li>' for _ in range(k))

    def named(tag: str, names: str) -> str:
        return f'<{tag} {pick(("class", "class", "id"))}="{pick(names.split())}{pick(("", "", "", " wide", " box-" + word()))}">'

    def unnamed(tag: str) -> str:
        """A tag without names, or with some that say nothing."""
        return pick((f"<{tag}>", f'<{tag} class="{word()}">', f'<{tag} id="{word()}{rng.randint(1, 99)}">', f'<{tag} class="{word()}-{word()} {word()}">'))

    def cue(k: int) -> str:
        """A short line that announces what is not the article."""
        words = run(1, 5).split(" ")
        for _ in range(k):
            words.insert(rng.randint(0, len(words)), pick(cues))
        return " ".join(words).capitalize() + pick(("", "", ".", "…", ":"))

    cues = sorted(CUES)
    teasers = lambda: "".join(f'<div><a href="/{word()}">{pick((short, sentence))()}</a></div>' for _ in range(rng.randint(2, 6)))
    off_tags = [
        lambda: unnamed(pick(("div", "div", "section"))) + f"<ul>{links(rng.randint(2, 9))}</ul></div>",
        lambda: unnamed("div") + pick((f"<h3>{cue(2)}</h3><ul>{links(4)}</ul>", f"<h4>{cue(2)}</h4>{teasers()}", f"<b>{cue(2)}</b>", cue(rng.randint(1, 3)), f"{cue(2)}<button>{word()}</button>", teasers())) + "</div>",
        lambda: unnamed("div") + f"&copy; {pick((short(), sentence()))} {cue(1)}</div>",
        lambda: unnamed("p") + pick((f"&copy; {run(1, 8)}", "".join(f"<a href=/{word()}>{run(1, 2)}</a> | " for _ in range(4)))) + "</p>",
        lambda: named("div", "outbrain taboola recirc recirculation recommendations teaser teasers more readnext promo trc") + pick((cue(2), f"<h3>{cue(2)}</h3>{teasers()}", teasers(), f"<p>{cue(1)}</p><ul>{links(4)}</ul>")) + "</div>",
        lambda: f"<nav>{pick(('<ul>' + links(rng.randint(2, 9)) + '</ul>', short()))}</nav>",
        lambda: named("div", "nav menu navbar navigation breadcrumb breadcrumbs main-menu topbar") + pick((f"<ul>{links(rng.randint(2, 9))}</ul>", short(), sentence())) + "</div>",
        lambda: named("ul", "menu nav nav-list pagination tags related-links social share breadcrumb") + links(rng.randint(2, 7)) + "</ul>",
        lambda: f"<header>{pick((f'<h1>{short()}</h1>', f'<p>{sentence()}</p>', short(), f'<div>{short()}</div><nav>{short()}</nav>'))}</header>",
        lambda: named("div", "header masthead site-header page-header banner topbar logo") + pick((short(), f"<p>{sentence()}</p>", f"<h2>{short()}</h2>")) + "</div>",
        lambda: f"<footer>{pick((f'&copy; {short()} &middot; {sentence()}', f'<p>{sentence()}</p>', f'<ul>{links(3)}</ul>', f'<p>{prose()}</p>'))}</footer>",
        lambda: named("div", "footer site-footer page-footer copyright legal colophon") + pick((sentence(), f"<p>{prose()}</p>", f"<ul>{links(4)}</ul>")) + "</div>",
        lambda: f"<aside>{pick((f'<p>{prose()}</p>', f'<h3>{short()}</h3><ul>{links(4)}</ul>', sentence()))}</aside>",
        lambda: named("div", "sidebar side widget related recommended most-read popular trending sidebar-right secondary") + pick((f"<p>{prose()}</p>", f"<h3>{short()}</h3><ul>{links(4)}</ul>", f"<h4>{short()}</h4><p>{sentence()}</p>")) + "</div>",
        lambda: named("div", "ad ads advert advertisement sponsored promo promotion ad-slot banner-ad sponsor adbox") + pick((sentence(), sentence(), f"<p>{prose()}</p>", prose(), f'<a href="/x">{sentence()}</a>', f"<div>{sentence()}</div>")) + "</div>",
        lambda: named(pick(("div", "div", "section", "p")), "cookie notice cookie-notice cookie-banner consent alert message gdpr newsletter subscribe signup paywall disclaimer warning popup modal overlay") + pick((sentence(), prose(), sentence() + "<button>Ok</button>")) + "</div>",
        lambda: f"<form action='/s'>{pick((f'<label>{short()}</label><input name=q>', f'<p>{sentence()}</p><input><button>{word()}</button>', sentence()))}</form>",
        lambda: named(pick(("div", "section", "ol", "ul")), "comments comment-list reader-comments responses discussion replies comment") + "".join(pick((f"<p>{prose()}</p>", f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f"<li>{prose()}</li>", f"<h3>{short()}</h3>", f'<article class="comment"><p>{prose()}</p></article>')) for _ in range(rng.randint(1, 4))),
        lambda: f'<div role="{pick(("navigation", "banner", "complementary", "contentinfo", "search"))}">{pick((sentence(), f"<p>{prose()}</p>", f"<ul>{links(3)}</ul>"))}</div>',
        lambda: f'<div class="{pick(("share", "social", "byline-links", "toolbar", "tags", "meta-links"))}">{"".join(f"<a href=/{word()}>{word()}</a> " for _ in range(3))}</div>',
        lambda: f"<script>var a='<p>{short()}</p>';</script><style>p{{color:red}}</style><noscript>{sentence()}</noscript>",
    ]

    def off() -> str:
        made = pick(off_tags)()
        opened = re.match(r"<(\w+)", made)[1]
        if opened == "section":
            made = made.removesuffix("</div>") + ("" if made.endswith("</section>") else "</section>")
        return made if made.endswith((f"</{opened}>", "</noscript>")) else f"{made.removesuffix('</div>')}</{opened}>"

    def inline(text: str) -> str:
        words = text.split(" ")
        for _ in range(pick((0, 0, 1, 2))):
            k = rng.randrange(len(words))
            tag = pick(("b", "i", "em", "strong", "span", "code", 'a href="/x"'))
            words[k] = f"<{tag}>{words[k]}</{tag.split(' ')[0]}>"
        return " ".join(words)

    out = []
    for _ in range(n):
        texts: list[str] = []

        def say(text: str, keep: list[str] = texts) -> str:
            keep.append(text)
            return inline(text)

        body = []
        lone = rng.random() < 0.1  # one block and no heading
        if not lone and rng.random() < 0.9:
            body.append(pick(("{}", "{}", "{}", "{}", "<div>{}</div>")).format(f"<h1>{say(short())}</h1>"))
        if rng.random() < 0.2:
            body.append(f"<p class=\"{pick(('lead', 'intro', 'summary', 'byline', 'dek', 'standfirst'))}\">{say(sentence())}</p>")
        only = rng.random() < 0.08  # nothing but blocks of one kind
        plain = rng.choice((0.9, 0.955))
        for _ in range(1 if lone else rng.randint(1, 9)):
            kind = pick((plain, 0.3, 0.94)) if lone else plain if only else rng.random()
            if kind < 0.55:
                body.append(f"<p>{say(pick((prose, prose, prose, sentence, short))())}</p>")
            elif kind < 0.61:
                body.append(f"<p><b>{say(prose())}<br><p>{say(prose())}</p>")
            elif kind < 0.67:
                level = pick("234")
                body.append(f"<h{level}>{say(short())}</h{level}>")
            elif kind < 0.8:
                kind_of = pick(("ul", "ol", "ol", "dl"))
                if kind_of == "dl":
                    items = "".join(f"<dt>{say(short())}</dt><dd>{say(sentence())}</dd>" for _ in range(rng.randint(1, 4)))
                else:
                    item = lambda: pick(("<li>{}</li>", "<li>{}</li>", "<li>{}", "<li><p>{}</p></li>")).format(say(pick((sentence, sentence, short, prose))()))
                    items = "".join(item() + (f"<ul>{item()}{item()}</ul>" if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 6)))
                body.append(pick((f"<{kind_of}>", unnamed(kind_of))) + items + f"</{kind_of}>")
            elif kind < 0.84:
                body.append(f"<blockquote>{say(sentence())}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{say(prose())}</p></blockquote>")
            elif kind < 0.87:
                body.append(f"<pre>{say(sentence())}</pre>")
            elif kind < 0.9:
                body.append("<table>" + "".join(f"<tr><td>{say(short())}</td><td>{say(word())}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind < 0.93:
                body.append(f"<figure><img src=x><figcaption>{say(sentence())}</figcaption></figure>")
            elif kind < 0.96:
                body.append(unnamed("div") + pick(("{}", "{}", "<div>{}</div>", "<p>{}</p>")).format(say(prose())) + "</div>")
            else:
                body.append(f"<section><h2>{say(short())}</h2><p>{say(prose())}</p></section>")
            if not lone and rng.random() < 0.12:
                body.append(off())
        if not lone and rng.random() < 0.15:
            body.append(off())
        container = pick(("article", "article", "article", "main", "div", "div", "section", "td"))
        names = "content article post entry entry-content article-body story main post-content article-text page-content body text"
        bare = rng.random() < 0.3  # a container whose names say nothing
        if bare:
            container, opened = "div", unnamed("div")
        else:
            opened = f"<{container}>" if container in ("article", "main") and rng.random() < 0.7 else named(container, names)
        if opened == "<article>" and body[0].startswith("<h1") and rng.random() < 0.3:
            body[0] = f"<header>{body[0]}</header>"
        inner = opened + "".join(body) + f"</{container}>"
        if bare and rng.random() < 0.25:
            inner = "".join(body)  # right in the body, or in its wrappers
        if container == "td":
            inner = f"<table><tr><td>{links(2)}</td>{inner}</tr></table>"
        if not lone and rng.random() < 0.3:
            inner = pick(('<div id="wrapper">', '<div class="container">', "<main>", "<div>", '<div class="row">')) + off() + inner + off() + "</div>"
        for _ in range(pick((0, 0, 1, 2)) if bare else 0):
            inner = unnamed("div") + inner + "</div>"
        beside = pick((0, 0, 2)) if lone else 4
        before, after = "".join(off() for _ in range(rng.randint(0, beside))), "".join(off() for _ in range(rng.randint(0, beside)))
        head = f"<!DOCTYPE html><html lang=x><head><meta charset=utf-8><title>{short()}</title><style>a{{}}</style></head>"
        out.append((f"{head}<body>{before}<!-- ad -->{inner}{after}" + pick(("</body></html>", "</body></html>", "")), texts))
    return out


def extracted(pages: DataFrame, labelled: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page; trained on ``labelled`` pages."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled or labelled_pages()))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = shared.value.extract(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")

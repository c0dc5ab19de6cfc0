"""Pages written by hand in layouts that the training pages do not copy, with the texts expected of them."""

import pytest

from newslake.llm import html

P = "The council agreed on a plan to rebuild the bridge before winter, officials said on Monday."
Q = "Work will begin in March and should take about nine months, according to the mayor."
R = "Residents had asked for a new crossing since the flood of last spring closed the old one."
MENU = "<ul><li><a href=/1>News</a></li><li><a href=/2>Sport</a></li><li><a href=/3>Weather</a></li></ul>"

PAGES = {
    "ordered list": (f"<body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>{P}</p><ol><li>Step one is to begin.</li><li>Step two is to end.</li></ol></article>", ["Title here", P, "Step one is to begin.", "Step two is to end."]),
    "definitions": (f"<body><main><h1>Terms</h1><dl><dt>Bridge</dt><dd>{P}</dd><dt>River</dt><dd>{Q}</dd></dl></main>", ["Terms", "Bridge", P, "River", Q]),
    "lone unnamed block": (f"<body><div id='c1'><div>{P} {Q}</div></div>", [f"{P} {Q}"]),
    "lone paragraph": (f"<html><body><p>{P} {R}</p></body></html>", [f"{P} {R}"]),
    "recommendations below": (f"<body><article><p>{P}</p><p>{Q}</p></article><div class='outbrain'>You may also like…</div>", [P, Q]),
    "recommendations inside": (f"<body><article><h1>Bridge plan</h1><p>{P}</p><div class='k3'><h4>Recommended</h4>{MENU}</div><p>{Q}</p></article>", ["Bridge plan", P, Q]),
    "names without meaning": (f"<body><div class='a9'>{MENU}</div><div class='q7'><h1>Bridge plan</h1><p>{P}</p><p>{Q}</p><p>{R}</p></div><div class='z2'>&copy; 2024 The Paper. All rights reserved.</div>", ["Bridge plan", P, Q, R]),
    "no names, three wrappers": (f"<body><div>{MENU}</div><div><div><div><h1>Bridge plan</h1><div>{P}</div><div>{Q}</div></div></div></div>", ["Bridge plan", P, Q]),
    "comments in a section": (f"<body><article><h1>Bridge plan</h1><p>{P}</p><p>{Q}</p></article><section id='comments'><h3>2 comments</h3><p>{R}</p></section>", ["Bridge plan", P, Q]),
    "comments as list": (f"<body><article><h1>Bridge plan</h1><p>{P}</p></article><ol class='comment-list'><li>{Q}</li><li>{R}</li></ol>", ["Bridge plan", P]),
    "aside within": (f"<body><article><h1>Bridge plan</h1><p>{P}</p><aside><p>{R}</p></aside><p>{Q}</p></article>", ["Bridge plan", P, Q]),
    "cookie notice": (f"<body><div class='cookie-notice'><p>We use cookies to improve your visit. Accept them?</p></div><div><h1>Bridge plan</h1><p>{P}</p><p>{Q}</p></div>", ["Bridge plan", P, Q]),
    "heading in the article's header": (f"<body><header><p>Daily Paper</p></header><article><header><h1>Bridge plan</h1></header><p>{P}</p><p>{Q}</p></article>", ["Bridge plan", P, Q]),
    "sections": (f"<body><nav>{MENU}</nav><main><h1>Bridge plan</h1><section><h2>Before</h2><p>{R}</p></section><section><h2>After</h2><p>{Q}</p></section></main><footer>Imprint</footer>", ["Bridge plan", "Before", R, "After", Q]),
    "quote": (f"<body><article><h1>Bridge plan</h1><p>{P}</p><blockquote>{Q}</blockquote><p>{R}</p></article>", ["Bridge plan", P, Q, R]),
    "links in prose": (f"<body><article><h1>Bridge plan</h1><p>The <a href=/c>council</a> agreed on a plan to rebuild the <a href=/b>bridge</a> before winter.</p><p>{Q}</p></article>", ["Bridge plan", "The council agreed on a plan to rebuild the bridge before winter.", Q]),
    "table of layout": (f"<body><table><tr><td>{MENU}</td><td id=text><h1>Bridge plan</h1><p>{P}</p><p>{Q}</p></td></tr></table>", ["Bridge plan", P, Q]),
    "advert between": (f"<body><div id=main><h1>Bridge plan</h1><p>{P}</p><div class='ad-slot'>Buy a new car today, with low rates.</div><p>{Q}</p></div>", ["Bridge plan", P, Q]),
    "form and script": (f"<body><form><label>Search</label><input></form><article><h1>Bridge plan</h1><script>var p='<p>x</p>'</script><p>{P}</p><p>{Q}</p></article>", ["Bridge plan", P, Q]),
    "menus only": (f"<body><nav>{MENU}</nav><footer>&copy; 2024 The Paper</footer>", []),
    "entities and spaces": (f"<body><article><h1>Bridge &amp; plan</h1><p>{P}\n\n &nbsp; {Q}</p></article>", ["Bridge & plan", f"{P} {Q}"]),
    "nested list": (f"<body><article><h1>Bridge plan</h1><p>{P}</p><ul><li>{Q}<ul><li>{R}</li></ul></li></ul></article>", ["Bridge plan", P, Q, R]),
    "sidebar beside": (f"<body><div class=row><div class=sidebar><h3>Most read</h3>{MENU}</div><div class=story><h1>Bridge plan</h1><p>{P}</p><p>{Q}</p></div></div>", ["Bridge plan", P, Q]),
    "share bar": (f"<body><article><h1>Bridge plan</h1><div class='share'><a href=/a>Mail</a> <a href=/b>Print</a></div><p>{P}</p><p>{Q}</p></article>", ["Bridge plan", P, Q]),
}


@pytest.fixture(scope="module")
def model():
    return html.fit(html.labelled_pages())


@pytest.mark.parametrize("name", PAGES)
def test_page(model, name):
    source, texts = PAGES[name]
    assert model.extract([source]) == ["\n".join(texts)]


def test_repeated_rows_and_clashing_columns(spark):
    source, texts = PAGES["quote"]
    rows = [(1, "u", source, "a", 7)] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = html.extracted(pages, html.labelled_pages(300)).collect()
    assert len(got) == 3 and {r.page_id for r in got} == {1} and len(set(got)) == 1
    assert got[0].n_chars == len(got[0].text) and P in got[0].text

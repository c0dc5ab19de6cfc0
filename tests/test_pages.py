"""Page operators against pages with known answers."""

from newslake.sources import pages as P


def test_listing():
    page = "<nav><a href=/n>not one of the five words</a></nav><h2><a href=/a>One two three four five</a></h2><h3><a href=/b>Too short here</a></h3><article><a href=/a>One two three four five again</a><a href=/c>six seven eight nine ten</a></article><p><a href=/d>a plain link of seven words here</a></p>"
    assert P.listing(P.Tree(page)) == [("/a", "One two three four five"), ("/c", "six seven eight nine ten")]
    plain = "<p><a href=/d>a plain link of seven words here</a><a href=/e>too few words</a></p><footer><a href=/f>a plain link of seven words here</a></footer>"
    assert P.listing(P.Tree(plain)) == [("/d", "a plain link of seven words here")]
    many = "".join(f"<h2><a href=/{i}>one two three four five {i}</a></h2>" for i in range(40))
    assert len(P.listing(P.Tree(many))) == 30 and P.listing(P.Tree(None)) == []


def test_headlines():
    page = "<div class='card big'><a href=/x><span class=t>First</span></a></div><a href=/y><h3>Second</h3></a><h3>Third</h3>"
    assert P.headlines(P.Tree(page), [".none", "span.t", "h3"]) == [("/x", "First")]
    assert P.headlines(P.Tree(page), ["h3"]) == [("/y", "Second"), ("", "Third")]
    assert P.headlines(P.Tree(page), ["div.card"]) == [("/x", "First")] and P.headlines(P.Tree(""), ["h3"]) == []


def test_deep_text():
    long = "word " * 60
    assert P.deep_text(P.Tree(f"<article><nav>menu</nav><p>{long}</p></article>")) == ("selector", long.strip())
    assert P.deep_text(P.Tree(f"<article>short</article><div><p>{long}</p><p>b</p></div><p>c</p>")) == ("density", long.strip() + "\nb")
    sentence = "x" * 60
    assert P.deep_text(P.Tree(f"<div><p>a</p><p>b</p></div><p>{sentence}</p>")) == ("paragraphs", sentence)
    assert P.deep_text(P.Tree(f"<article>{'word ' * 45} Unlock this article today</article>")) == ("paywall", "")
    assert P.deep_text(P.Tree(f"<article>{'word ' * 90} Unlock this article today</article>"))[0] == "selector" and P.deep_text(P.Tree("")) == ("", "")


def test_context_links():
    page = "<main><p>some words stand around it <a href=/news/2024/01/a-long-slug-here>read all of it now</a></p></main><a href=/about>About</a><p><a href=/news/x>four words in here</a></p>"
    assert P.context_links(P.Tree(page)) == [("/news/2024/01/a-long-slug-here", "read all of it now", 1.0), ("/news/x", "four words in here", 0.4)]


def test_blocks_and_json():
    page = "<div>short<section>a much longer text stands here<p>and goes on</p></section></div><script type='application/ld+json'>{\"a\": [{\"articleBody\": \"the whole body\"}, {\"title\": \"a title that is longer than it\"}]}</script><script type=application/json>{broken</script>"
    tree = P.Tree(page)
    assert P.largest_block(tree) == "a much longer text stands here and goes on" and P.json_text(tree) == "the whole body"
    assert P.largest_block(P.Tree("")) == "" == P.json_text(P.Tree(""))

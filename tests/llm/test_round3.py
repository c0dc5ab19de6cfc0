"""Spelling variants, URL filters and periodic runs against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newslake.llm import periodic, spelling, urlfilter

# --- spelling ---------------------------------------------------------------------------------------------------------


def variants(rows):
    """word: (form, root, n, n_near, form_n), from all edits over the alphabet."""
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    signs = {c for w in known for c in w}

    def near(w):
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in signs for k in (0, 1) if i + k <= len(w)}
        return [x for x in made - {w} if x in known]

    form, n_near = {}, {}
    for w, n in known.items():
        each = near(w)
        best = min(((-known[x], x) for x in each), default=(0, None))
        form[w], n_near[w] = best[1] if -best[0] >= 2 * n else None, len(each)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, n_near[w], known.get(form[w])) for w, n in known.items()}


def got_variants(df):
    rows = spelling.variants(df).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants(spark, odd, odd_rows, none):
    rng = random.Random(3)
    base = ["banana", "bananna", "banaana", "colour", "color", "colours", "Colour", "éclair", "eclair", "éclairs", "aaaaa", "aaaaaa", "aaaaaaa", "Àbcde", "àbcde", "abcde", "z" * 70, "z" * 71, "z" * 30 + "y" + "z" * 40, "q" * 3000, "q" * 3001]
    rows = [(i, " ".join(rng.choices(base, k=60)) + " 漢字 x×÷yzw") for i in range(40)] + [(None, "banana " * 9), (7, None), (8, "")]
    chain = [("lllll", 3), ("llllla", 6), ("llllab", 2), ("lllllab", 12), ("lllllabc", 24), ("lllllabcd", 60), ("lllllabcde", 200)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    expected = variants(rows)
    assert got_variants(spark.createDataFrame([(*r, "x", 5, 7) for r in rows], "doc_id bigint, text string, word string, n int, zone int")) == expected
    assert expected["lllll"][:2] == ("llllla", "lllllabcde")
    assert got_variants(odd) == variants([(r[0], r[1]) for r in odd_rows])
    assert got_variants(none) == {}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab\u00e9", min_size=5, max_size=9), min_size=2, max_size=40))
def test_each_neighbour_once(words):
    """All groups in one batch: every near pair comes out once in both directions, no other does."""
    rows = [(w.encode("latin-1"), m, z) for w in words for m in (len(w), len(w) - 1) if m >= 5 for z in range((m - 1) // spelling.ZONE + 1)]
    found = Counter((rows[r][0], w) for at, near in spelling.neighbours([r[0] for r in rows], *(np.array([r[k] for r in rows]) for k in (1, 2)), "ab\u00e9".encode("latin-1")) for r, w in zip(at, near))

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    coded = [w.encode("latin-1") for w in words]
    assert found == Counter((a, b) for a in coded for b in coded if apart(a, b))


# --- url filters ------------------------------------------------------------------------------------------------------


def page(i, url, *links):
    return (i, url, "".join(f'<p>x<a class="k" href="{x}">y</a>' for x in links), "h", "p", "r")


PAGES = [
    page(1, "https://A.Good.org/en/2", "http://mid.net/x", "//MID.net?x", "/local", "https://a.good.org/self"),
    page(2, "http://mid.net/", "https://far.net/page"),
    page(3, "http://far.net/es/1"),
    page(4, "http://spam.com/de/1", "http://victim.net/"),
    page(5, "http://farm.net/1", "http://spam.com/de/1", "http://spam.com/de/2"),
    page(6, "http://feeder.net/1", "http://farm.net/1"),
    page(7, "http://victim.net/1#top"),
    page(8, "http://spam.com/en/1"),
    page(9, "http://x.example.org/es/9"), page(10, "http://example.org/en/12"), page(11, "http://example.org"), page(12, "http://notexample.org/en/1"),
    page(13, "http://m.fr.com/fr/1"), page(14, "http://m.fr.com/de/1"), page(15, "http://m.fr.com/en/1"),
    page(16, "no address"), page(17, "mailto:a@b"), page(18, "://odd.org/p?x://y"), page(19, "http://q.net?a=/b"), page(20, "http://corg/en/1"),
    (21, None, None, "h", "p", "r"), (None, "http://mid.net/", "", "h", "p", "r"), (3, "http://far.net/es/1", "<a href='http://mid.net'>" * 3, "h", "p", "r"),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, host string, path string, rule string")
    got = sorted(map(tuple, urlfilter.filtered_urls(df).collect()), key=str)
    con = duckdb.connect()
    con.register("t", df.toPandas().astype({"page_id": "Int64"}))
    con.execute("CREATE TABLE pages AS SELECT * FROM t")
    assert got == sorted(con.execute(urlfilter.oracle()).fetchall(), key=str)
    verdict = {r[0]: r[1:] for r in got}
    assert verdict[1] == ("a.good.org", "/en/2", "org/", "allow") and verdict[9][2:] == ("example.org/es/", "block") and verdict[10][2:] == ("example.org/en/1", "block")
    assert verdict[11][1:] == ("", None, "block") and verdict[12][2] == "org/" and verdict[20][2] is None and verdict[21] == ("", "", None, "allow")
    assert [verdict[i][3] for i in (5, 6, 8)] == ["block"] * 3  # links to a blocked host, a link to that, and a host that is partly blocked
    assert [verdict[i][3] for i in (2, 3, 7, 15, 19)] == ["allow"] * 5
    assert urlfilter.filtered_urls(df.limit(0)).count() == 0


def test_propagation(spark):
    """Scores equal a plain walk on a random graph."""
    rng = random.Random(8)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.randrange(1, 5) for _ in range(120)}
    total = Counter()
    for (a, _), w in edges.items():
        total[a] += w
    seeds = {0: 1.0, 3: 0.25, 77: 0.5}
    x = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(60):
        y = Counter({h: 0.15 * s for h, s in seeds.items()})
        for (a, b), w in edges.items():
            y[b] += 0.85 * x.get(a, 0) * w / total[a]
        x = y
    shares = spark.createDataFrame([(str(a), str(b), w / total[a]) for (a, b), w in edges.items()], "source string, target string, share double")
    got = urlfilter.propagated(shares, spark.createDataFrame([(str(h), s) for h, s in seeds.items()], "host string, seed double"), rounds=60).collect()
    assert {r.host: r.score for r in got if r.score} == pytest.approx({str(h): s for h, s in x.items() if s}, abs=1e-6)


def test_no_python_on_the_url_path(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, host string, path string, rule string")
    plan = urlfilter.filtered_urls(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- periodic runs ----------------------------------------------------------------------------------------------------


def all_runs(a):
    out = []
    for q in range(1, len(a) // 4 + 1):
        k = 0
        while k + q < len(a):
            if a[k] != a[k + q]:
                k += 1
                continue
            s = k
            while k + q < len(a) and a[k] == a[k + q]:
                k += 1
            n = k - s + q
            w = a[s : s + n]
            if n >= max(6, 4 * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repeated(draw):
    parts = draw(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=5))
    return [x for piece, times, more in parts for x in (piece * times + piece[:more])]


@settings(max_examples=400, deadline=None)
@given(repeated())
def test_runs(a):
    assert periodic.runs_of(periodic.numbered(a)) == all_runs(a)


@pytest.mark.parametrize("direct", [1, 8])
def test_long_runs(monkeypatch, direct):
    monkeypatch.setattr(periodic, "DIRECT", direct)
    rng = random.Random(direct)
    for _ in range(20):
        a = [rng.randrange(3) for _ in range(900)]
        for _ in range(4):
            s, p = rng.randrange(900), rng.randrange(1, 60)
            e = min(900, s + p * rng.randrange(3, 9) + rng.randrange(p))
            a = [a[s + (i - s) % p] if s <= i < e else a[i] for i in range(900)]
        assert periodic.runs_of(periodic.numbered(a)) == all_runs(a)


def test_collisions(monkeypatch):
    """Hashes that always agree change nothing."""
    monkeypatch.setattr(periodic.Common, "_equal", lambda *_: True)
    monkeypatch.setattr(periodic, "DIRECT", 1)
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(2) for _ in range(40)] + [0, 1] * 9 + [rng.randrange(2) for _ in range(20)] + [0] * 9
        assert periodic.runs_of(periodic.numbered(a)) == all_runs(a)


def expected_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if doc_id is not None and words:
        h, n = crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda t: sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_periodic(spark, odd, odd_rows, none):
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + [(200 + i, "the same line again " * (i % 9) + "ein\x0b\u00a0wort " * (i % 4), "en", None) for i in range(60)]
    df = spark.createDataFrame([(r[0], r[1], 3, 4, "p") for r in rows], "doc_id bigint, text string, start int, length int, period string")
    got = sorted((tuple(r)[:8] for r in periodic.periodic(df, plant=True).collect()), key=str)
    assert got == sorted((expected_row(r[0], r[1]) for r in rows), key=str)
    assert periodic.periodic(odd, plant=True).count() == len(odd_rows) and periodic.periodic(none).count() == 0


def test_without_runs(spark):
    rows = [(1, "a b " * 9 + "c", 37), (2, "no  runs\there", 13), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    assert sorted(map(tuple, periodic.without_runs(df).collect())) == [(1, "a b c", 5), (2, "no  runs\there", 13), (3, None, None)]

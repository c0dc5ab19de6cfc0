"""D2 to D5 and D9 against folds and sets in plain Python."""

import difflib
import random

import numpy as np

from newslake.operators import dedup
from newslake.operators.bloom import Bloom


def titles(n=160, seed=4):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(30)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        out.append("".join(t))
    return out + ["", "a", "a", "b", "ab", "abc", "abd"]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_pairs_are_all(spark):
    own = list(dict.fromkeys(t for t in titles() if t))
    rows = spark.createDataFrame(list(enumerate(own)), "id bigint, title string")
    for least in (0.85, 0.9, 0.6):
        got = {(r.a, r.b) for r in dedup.ratio_pairs(rows, least).collect()}
        assert got == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if ratio(own[i], own[j]) > least}


def test_edit_dedup(spark):
    own = titles()
    kept, want = [], []
    for i, t in enumerate(x.lower().strip() for x in own):
        if not t or all(abs(len(t) - len(k)) > 0.2 * max(len(t), len(k)) + 1e-9 or t != k and ratio(min((j, k), (i, t))[1], max((j, k), (i, t))[1]) <= 0.85 for j, k in kept):
            want.append(i)
            kept += [(i, t)] if t else []
    got = {r.id for r in dedup.edit_dedup(spark.createDataFrame(list(enumerate(own)), "id bigint, title string")).collect() if r.accepted}
    assert got == set(want) and len(want) < len(own)


def test_signatures_by_linear_maps(spark):
    rng = random.Random(1)
    prime = int(dedup.PRIME)
    x = [rng.randrange(prime) for _ in range(500)] + [0, 1, prime - 1]
    a = rng.randrange(prime)
    assert dedup.times(np.array(x, np.uint64), np.uint64(a)).tolist() == [v * a % prime for v in x]
    words = [[f"w{k}" for k in range(i * 10, i * 10 + 300)] for i in range(4)] + [["one"], ["one"], []]
    rows = spark.createDataFrame(list(enumerate(words)), "id bigint, words array<string>")
    signed = {r.id: r.sig for r in dedup.minhash(rows, 512, family="md5").collect()}
    for i in range(4):
        for j in range(i):
            shared = 300 - 10 * (i - j) - 2
            assert abs(sum(p == q for p, q in zip(signed[i], signed[j])) / 512 - shared / (596 - shared)) < 0.09
    assert signed[4] == signed[5] and 6 not in signed
    gate = {r.id: r.accepted for r in dedup.minhash_gate(rows).collect()}
    assert gate == {0: True, 1: False, 2: gate[2], 3: gate[3], 4: True, 5: False}


def test_three_tiers(spark):
    rng = random.Random(7)
    body = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    bodies = [body() for _ in range(12)]
    names = ["the first title of a long story", "the first title of a long stors", "another headline about other things", "something else entirely is told here", ""]
    rows = [(i, f"u{rng.randrange(25)}" if i % 9 else None, rng.choice(names) + rng.choice(["", "", f" {i} {i * i}"]), rng.choice([rng.choice(bodies), "short", None, body()])) for i in range(70)]
    kept, want = [], {}
    runs = lambda t: {tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))}
    for i, u, t, b in rows:
        b = b or ""
        tier = None
        if u and any(u == k[0] for k in kept):
            tier = "url"
        elif t and any(k[1] and ratio(k[1], t) >= 0.9 for k in kept):
            tier = "title"
        elif b and any(k[2] and (b == k[2] or len(b) >= 50 <= len(k[2]) and len(runs(b) & runs(k[2])) / len(runs(b) | runs(k[2])) >= 0.8) for k in kept):
            tier = "content"
        want[i] = tier
        if not tier:
            kept.append((u, t, b))
    got = {r.id: r.tier for r in dedup.three_tiers(spark.createDataFrame(rows, "id bigint, url string, title string, body string")).collect()}
    assert got == want and {"url", "title", "content"} <= set(want.values())


def test_bloom(spark):
    rows = spark.createDataFrame([(f"v{i}",) for i in range(2000)], "v string")
    low, high = rows.filter("substring(v, 2) < '5'"), rows.filter("substring(v, 2) >= '5'")
    a, b = Bloom.of(low, "v", 2000, 0.01), Bloom.of(high, "v", 2000, 0.01)
    both, whole = a.merged(b), Bloom.of(rows, "v", 2000, 0.01)
    assert sorted(map(tuple, both.words.collect())) == sorted(map(tuple, whole.words.collect()))
    assert both.held(rows, "v").filter("NOT maybe").count() == 0
    others = spark.createDataFrame([(f"x{i}",) for i in range(3000)], "v string")
    assert both.held(others, "v").filter("maybe").count() / 3000 < 0.03
    f = both.fill().first()
    assert 0.4 < f.fill < 0.6 and 0.002 < f.expected_false_share < 0.03 and f.bytes == 8 * -(-both.m // 64)


def test_ratios_of_long_titles(spark):
    """Titles on both sides of 200 characters, from which on difflib skips frequent ones; lengths apart."""
    rng = random.Random(12)
    syllables = "th er on an re he in ed nd ha at en es of or".split()
    own = []
    for k in range(40):
        t = list(" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.choice([20, 36, 40, 60, 150]))).capitalize() + rng.choice([".", "!?", " K7", ""]))
        own.append("".join(t))
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randrange(1, max(2, len(u) // 8))):
                at = rng.randrange(len(u))
                u[at : at + rng.randrange(3)] = rng.choice(["", "é", "q", "th", "漢"])
            own.append("".join(u))
    own = list(dict.fromkeys(own))
    rng.shuffle(own)
    rows = spark.createDataFrame(list(enumerate(own)), "id bigint, title string")
    for least, share in ((0.85, 0.2), (0.9, 1.0)):
        got = {(r.a, r.b) for r in dedup.ratio_pairs(rows, least, share).collect()}
        fits = lambda x, y: min(len(x), len(y)) > max(len(x), len(y)) * (1 - share - 1e-9)  # noqa: E731, B023
        want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if fits(own[i], own[j]) and ratio(own[i], own[j]) > least}
        assert got == want and len(want) > 10


def test_ratio_candidates_are_few(spark):
    """Titles of the same syllables share most trigrams, but few of their pairs are left to difflib."""
    rng = random.Random(13)
    syllables = "th er on an re he in ed nd ha at en es of or".split()
    own = list(dict.fromkeys(" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(12, 30)))[:120] for _ in range(400)))
    rows = spark.createDataFrame(list(enumerate(own)), "id bigint, title string")
    assert dedup.ratio_candidates(rows, 0.85, 0.2).count() < len(own) / 10


def test_pairs_on_demand(spark):
    """Of 300 titles that are all alike, the pairs of the first are judged and no others."""
    seen = spark.sparkContext.accumulator(0)

    def judged(pairs):
        seen.add(pairs.count())
        return pairs.selectExpr("a", "b", "1.0D AS sim")

    nodes = spark.range(300).selectExpr("id", "IF(id % 7 = 0, NULL, 1000 - id) AS rank")
    pairs = spark.range(300).selectExpr("id AS a").crossJoin(spark.range(300).selectExpr("id AS b")).filter("a < b")
    ok, edges = dedup.settled_on_demand(nodes, pairs, judged)
    assert [r.node for r in ok.collect()] == [299] and edges.count() == 299 and seen.value == 299


def test_similar_sets_without_all_pairs(spark):
    """Candidates of sets that share frequent members are few, and pairs are those of brute force."""
    rng = random.Random(21)
    common, seen = [f"c{k}" for k in range(40)], {}
    for i in range(240):
        base = random.Random(i % 12)
        own = set(base.sample(common, 12)) | {f"w{i % 12}-{k}" for k in range(14)}
        for _ in range(rng.randrange(9)):
            own.discard(rng.choice(sorted(own)))
            own.add(f"n{rng.randrange(400)}")
        seen.setdefault(tuple(sorted(own)), i)
    rows = [(i, list(s)) for s, i in seen.items()] + [(1000 + i, rng.sample(common, 12) + [f"x{i}-{k}" for k in range(9)]) for i in range(150)]
    sets = spark.createDataFrame(rows, "id bigint, set array<string>")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for least in (0.7, 0.45):
        want = {(i, j) for i, a in rows for j, b in rows if i < j and alike(a, b) >= least - 1e-12}
        assert {(r.a, r.b) for r in dedup.similar_pairs(sets, least).collect()} == want and len(want) > 100
        assert dedup.similar_candidates(sets, least).count() < 3 * len(want)

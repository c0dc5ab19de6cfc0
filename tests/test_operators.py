import itertools
import random

import pytest
from pyspark.sql import functions as F

from newslake.operators import dedup, folds, graph, quantiles, store
from newslake.operators import stages as G


def shingled(title):
    w = title.lower().split()
    return set(w) | {" ".join(p) for p in zip(w, w[1:])}


def jac(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(3)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=6)) for _ in range(25)]
    out = []
    for i in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice("alpha beta gamma new old".split())
        out.append((i, " ".join(w)))
    return out


def test_similar_pairs(spark, titles):
    rows = dedup.classes(spark.createDataFrame(titles, "id bigint, title string"), "id", "title")
    heads = rows.filter("id = class")
    got = {(r.a, r.b): r.sim for r in dedup.similar_pairs(heads.select("id", "set"), 0.5).collect()}
    first = {}
    for i, t in titles:
        first.setdefault(frozenset(shingled(t)), (i, t))
    want = {(a[0], b[0]): jac(a[1], b[1]) for a, b in itertools.combinations(sorted(first.values()), 2) if jac(a[1], b[1]) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_greedy(spark, titles):
    got = {r.id: (r.accepted, r.matched_id) for r in dedup.greedy(spark.createDataFrame(titles, "id bigint, title string")).collect()}
    kept, want = [], {}
    for i, t in titles:
        best = max(((jac(t, u), -j) for j, u in kept), default=(0, 0))
        if best[0] >= 0.7 - 1e-12:
            want[i] = (False, -best[1])
        else:
            want[i] = (True, None)
            kept.append((i, t))
    assert got == want


def test_clusters(spark, titles):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, t, ["x"] if i % 3 else ["y"], start + datetime.timedelta(hours=i * 2)) for i, t in titles]
    got = {r.id: r.event for r in dedup.clusters(spark.createDataFrame(rows, "id bigint, title string, tags array<string>, discovered_at timestamp")).collect()}
    events, want = [], {}
    for i, t, tags, at in rows:
        best, sim = None, 0.0
        for e in events:
            if (at - e["last"]).total_seconds() > 48 * 3600:
                continue
            s = jac(t, e["title"]) + (0.1 if set(tags) & e["tags"] else 0)
            if s > sim:
                best, sim = e, s
        if best and sim >= 0.55:
            best["last"], want[i] = at, best["id"]
            best["tags"] |= set(tags)
        else:
            events.append({"id": i, "title": t, "tags": set(tags), "last": at})
            want[i] = i
    assert got == want


def test_components_and_crawl(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 3), (100, 25), (200 , 201)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert got[9] == 0 and got[29] == 0 and got[100] == 0 and got[15] == 10 and got[201] == 200
    assert graph.components(frame.limit(0)).count() == 0
    seeds = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.depth for r in graph.crawl(frame, seeds, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_at_ranks(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(50))) for k in "ab" for _ in range(rng.randrange(90, 130))]
    got = {r.k: (r.p50, r.p99) for r in quantiles.at_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for k in "ab":
        own = sorted(v for x, v in rows if x == k)
        assert got[k] == tuple(own[min(len(own) - 1, int(len(own) * p))] for p in (0.5, 0.99))


def test_health_machine():
    import datetime
    from types import SimpleNamespace

    at = datetime.datetime(2024, 1, 1)
    s, out = folds.health_start(), []
    for hours, ok, code in [(0, True, 200), (1, False, 500), (2, False, 429), (3, False, 404), (4, False, 500), (200, False, 500), (201, True, 200)]:
        out.append(folds.health_step(s, SimpleNamespace(source_id=1, ts=at + datetime.timedelta(hours=hours), success=ok, status_code=code))["status"])
    assert out == ["healthy", "degraded", "rate_limited", "quarantined", "degraded", "cooldown", "healthy"]
    s = folds.health_start() | {"status": "quarantined", "until": at}
    assert folds.health_step(s, SimpleNamespace(source_id=1, ts=at, success=False, status_code=500))["status"] == "dead"


def test_folds_keep_order(spark):
    rows = [(k, i) for k in range(5) for i in range(50)]

    def step(state, row):
        state["n"] += 1
        return {"k": row.k, "i": row.i, "n": state["n"]}

    got = folds.folded(spark.createDataFrame(rows, "k bigint, i bigint").repartition(7), "k", ["i"], lambda: {"n": 0}, step, "k bigint, i bigint, n bigint").collect()
    assert len(got) == 250 and all(r.n == r.i + 1 for r in got)


def test_confidence(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "A", 2, False, at, 1), (1, "B", 1, True, at + datetime.timedelta(hours=1), 2), (2, "C", 4, False, at, 3), (2, "c ", 1, False, at, 4)]
    got = {r.event_id: r.confidence for r in dedup.confidence(spark.createDataFrame(rows, "event_id int, source_name string, source_tier int, is_primary boolean, discovered_at timestamp, article_id int")).collect()}
    assert got == {1: 0.9, 2: 0.7}


def test_stages_keep_first_reason(spark):
    rows = spark.createDataFrame([("http://a.com/x", "T"), (None, "A long enough title")], "url string, title string").withColumns({"summary": F.lit(""), "published_at_hint": F.lit(None).cast("timestamp"), "observed_at": F.current_timestamp()})
    out = [r.rejection_reason for r in G.good(G.relevant(G.fresh(G.normalized(rows), F.current_timestamp()))).collect()]
    assert out == ["INVALID_TITLE", "INVALID_URL"]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in store.upserted(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "c"), (3, "e")]
    path = f"{tmp_path}/t"
    store.replaced(old, path)
    store.replaced(store.upserted(store.current(spark, path), new, ["k"], "t"), path)
    assert store.current(spark, path).count() == 3
    assert store.inserted_or_ignored(old, new.filter("v <> 'e'"), ["k"]).count() == 3

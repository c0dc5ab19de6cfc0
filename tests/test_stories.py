"""Events and titles kept between batches, against folds in plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.lake import written
from newslake.operators import dedup
from newslake.operators.segments import Conflict
from newslake.operators.stories import EventStore, TitleIndex

START = datetime(2024, 5, 1)
SCHEMA = "id bigint, title string, tags array<string>, discovered_at timestamp, event string, kind string"


def shingles(title):
    w = title.lower().split()
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def story(n, seed, hours=0.7):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=rng.randrange(3, 7))) for _ in range(8)]
    rows, at = [], START
    for i in range(n):
        at += timedelta(hours=rng.choice([0, hours, hours, 3 * hours, 60 if rng.random() < 0.05 else hours]))
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice(["omega", "sigma", "alpha"])
        rows.append((i, " ".join(words) if rng.random() < 0.97 else "", rng.choice([["AI"], ["ai", "law"], [], ["chips", None]]), at, "e", "k"))
    return rows


def fold(rows, window=48, threshold=0.55, bonus=0.1):
    events, out = [], {}
    for i, title, tags, at, *_ in rows:
        own, tags = shingles(title), {t.lower() for t in tags if t}
        best, sim = None, 0.0
        for e in events:
            if e["last"] < at - timedelta(hours=window):
                continue
            s = alike(own, e["words"]) + (bonus if tags & e["tags"] else 0.0)
            if s > sim:
                best, sim = e, s
        if best and sim >= threshold:
            best["last"], out[i] = at, (best["id"], "merged_existing")
            best["tags"] |= tags
        else:
            events.append({"id": i, "words": own, "tags": tags, "last": at})
            out[i] = (i, "created_new")
    return out, events


@pytest.mark.parametrize("cuts", [[40, 41, 90], [35, 70, 105]])
def test_batches_of_events(spark, tmp_path, cuts):
    rows = story(140, 3)
    want, events = fold(rows)
    assert len(events) < 100 and sum(a == "merged_existing" for _, a in want.values()) > 30
    store = EventStore(spark, str(tmp_path / "e"))
    got = {}
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        told = store.add(spark.createDataFrame(rows[a:b], SCHEMA))
        got |= {r.id: (r.event, r.action) for r in told.collect()}
    assert got == want
    assert {(r.event, r["last"]) for r in store.events().collect()} == {(e["id"], e["last"]) for e in events}


def test_events_again(spark, tmp_path):
    """A batch that runs again changes nothing; expired events go, open ones stay; odd rows."""
    rows = story(60, 5)
    df = lambda r: spark.createDataFrame(r, SCHEMA)
    store = EventStore(spark, str(tmp_path / "e"))
    store.add(df(rows[:30]))
    first = sorted(map(tuple, store.add(df(rows[30:])).collect()))
    assert sorted(map(tuple, store.add(df(rows[30:])).collect())) == first and store.members().count() == 60
    before = {r.event for r in store.events().collect()}
    store.expired(rows[-1][3])
    open_ = {e["id"] for e in fold(rows)[1] if e["last"] >= rows[-1][3] - timedelta(hours=48)}
    assert {r.event for r in store.events().collect()} == open_ and open_ < before
    assert store.add(df([(None, "x", [], START, "", ""), (900, "alpha", [], None, "", "")])).count() == 0
    assert store.add(df([])).count() == 0
    late = store.add(df([(901, None, None, rows[-1][3], "", ""), (902, "word " * 9000, None, rows[-1][3], "", ""), (902, "word " * 9000, None, rows[-1][3], "", "")]))
    assert {r.action for r in late.collect()} == {"created_new"} and store.members().count() == 62


def test_event_stream(spark, tmp_path):
    rows = story(50, 9)
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:25], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    store = EventStore(spark, str(tmp_path / "e"))
    for k in range(2):
        if k:
            spark.createDataFrame(rows[25:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        store.follow(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "c")).awaitTermination()
    assert {r.id: (r.event, r.action) for r in store.members().collect()} == fold(rows)[0]


def greedy(rows, cap=None, threshold=0.7):
    """Decisions in order of id within batches; older titles go at the ends of batches."""
    index, out = [], {}
    for batch in rows:
        for i, title in sorted(batch):
            own = shingles(title)
            near = [(-round(alike(own, s), 9), age, j, alike(own, s)) for age, j, s in index if own and alike(own, s) >= threshold - 1e-12]
            best = min(near, default=None)
            out[i] = (best is None, best and best[2])
            if best is None and own:
                index.append((1, i, own))
        index = [(0, i, s) for _, i, s in index][-cap if cap else 0 :]
    return out


@pytest.mark.parametrize("cap", [None, 12])
def test_titles(spark, tmp_path, cap):
    rows = [(i, r[1]) for i, r in enumerate(story(120, 11))]
    batches = [rows[:50], rows[50:52], rows[52:]]
    index = TitleIndex(spark, str(tmp_path / "t"), cap=cap)
    got = {}
    df = lambda r: spark.createDataFrame(r, "id bigint, title string")
    for b in batches:
        told = index.add(df(b)).collect()
        got |= {r.id: (r.accepted, r.matched_id) for r in told}
        again = index.add(df(b)).collect()
        assert sorted(map(tuple, again), key=str) == sorted(map(tuple, told), key=str)
    assert got == greedy(batches, cap)
    if cap:
        assert index.titles().count() == cap
    else:
        one = dedup.greedy(df(rows)).collect()
        assert {r.id: (r.accepted, r.matched_id) for r in one} == got


def test_titles_not_passed(spark, tmp_path):
    """What fails its quality is decided, never kept, and rejects none."""
    index = TitleIndex(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a b c d", False), (2, "a b c d", True), (3, "a b c d", True), (4, None, True), (None, "a b c d", True), (5, "a b c d e f g h i j k l", False), (6, "a b c d e f g h i j k m", True)], "id bigint, title string, good boolean")
    got = {r.id: (r.accepted, r.matched_id) for r in index.add(rows, F.col("good")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (True, None), 6: (True, None)}
    assert sorted(r.id for r in index.titles().collect()) == [2, 6]
    assert index.add(rows.limit(0)).count() == 0


def test_two_stores(spark, tmp_path, monkeypatch):
    """Of two writers one is refused, and what it wrote is not seen."""
    a, b = (TitleIndex(spark, str(tmp_path / "t")) for _ in range(2))
    state = b.parts.state()
    a.add(spark.createDataFrame([(1, "x y z")], "id bigint, title string"))
    monkeypatch.setattr(b.parts, "state", lambda: state)
    with pytest.raises(Conflict):
        b.add(spark.createDataFrame([(2, "x y z")], "id bigint, title string"))
    assert [r.id for r in a.titles().collect()] == [1] and written(a.titles()).count() == 1 and T.WORD


@pytest.mark.parametrize(("kept", "whole"), [("c1_event_store", "c1_event_clusters"), ("j7_title_index", "d1_greedy_dedup")])
def test_queries_in_batches(spark, kept, whole):
    from newslake.plans import QUERIES

    own, other = (QUERIES[name](spark, "/root/testdata/sf0.001") for name in (kept, whole))
    columns = sorted(other.columns)
    assert sorted(map(tuple, own.select(columns).collect()), key=str) == sorted(map(tuple, other.select(columns).collect()), key=str)

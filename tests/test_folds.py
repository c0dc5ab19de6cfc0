"""Ordered folds through their registered queries, against plain replays of all rows in one list."""

import json
import random
from datetime import timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newslake.operators import folds
from newslake.plans import QUERIES

SF = "/root/testdata/sf0.001"
DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def events():
    rows = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    return [(int(r.user_id), int(r.event_id), r.ts.to_pydatetime(), r.event_type, float(r.value)) for r in rows.itertuples()]


def got(spark, name, *columns):
    return {r.event_id: tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()}


def test_rate_limit(spark, events):
    """A bucket of three tokens that gains one an hour: what is spent never exceeds what came in."""
    want, level, last = {}, {}, {}
    for user, event, ts, *_ in events:
        now = ts.replace(tzinfo=timezone.utc).timestamp()
        have = 3.0 if user not in level else min(3.0, level[user] + (now - last[user]) / 3600)
        last[user] = now
        want[event] = (have >= 1, 0.0 if have >= 1 else round((1 - have) * 3600, 3))
        level[user] = have - 1 if have >= 1 else have
    found = got(spark, "r10_rate_limit", "allowed", "retry_after")
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 0.01 for k in want)


def test_alert_limit(spark, events):
    want, sent = {}, {}
    for user, event, ts, _, value in events:
        if value >= 75:
            own = sent.setdefault(user % 5, [])
            want[event] = (sum(t > ts - timedelta(hours=1) for t in own) < 2,)
            if want[event][0]:
                own.append(ts)
    assert got(spark, "w4_alert_limit", "sent") == want


def test_cache(spark, events):
    """Least recently used of twenty items, each good for a day from when it was read in."""
    want, held = {}, {}
    for user, event, ts, *_ in events:
        own, item = held.setdefault(user % 4, []), event * 7 % 50
        entry = next((x for x in own if x[0] == item), None)
        hit = entry is not None and ts - entry[1] <= DAY
        want[event] = (hit,)
        if entry:
            own.remove(entry)
        own.append(entry if hit else (item, ts))
        del own[:-20]
    assert got(spark, "r11_cache_replay", "hit") == want


def test_leases(spark, events):
    want, held = {}, {}
    for user, event, ts, *_ in events:
        holder, until, token = held.get(user % 10, (None, None, 0))
        worker = event % 3
        expired = holder is None or ts >= until
        won = expired or holder == worker
        if expired and holder != worker:
            token += 1
        if won:
            held[user % 10] = (worker, ts + timedelta(hours=1), token)
        want[event] = (won, token)
    assert got(spark, "r9_lease_replay", "acquired", "token") == want


def test_discovery(spark, events):
    legal = {("discovered", "testing"), ("discovered", "rejected"), ("testing", "approved"), ("testing", "rejected"), ("testing", "probation"), ("probation", "approved"), ("probation", "rejected"), ("approved", "active"), ("approved", "retired"), ("active", "retired"), ("active", "probation")}
    names, want, state = ["discovered", "testing", "probation", "approved", "active", "rejected", "retired"], {}, {}
    for user, event, *_ in events:
        before, asked = state.get(user, "discovered"), names[event % 7]
        state[user] = asked if (before, asked) in legal else before
        want[event] = (before, state[user], (before, asked) in legal)
    assert got(spark, "r8_discovery_fsm", "before", "after", "legal") == want


def test_health_by_batch_and_stream(spark, events):
    k = {int(r.event_id): int(json.loads(r.props)["k"]) for r in pd.read_parquet(f"{SF}/events.parquet").itertuples()}
    want, state = {}, {}
    for user, event, ts, kind, _ in events:
        status, fails, oks, code, until = state.get(user, ("healthy", 0, 0, None, None))
        if status == "quarantined" and until and ts >= until:
            status = "probation"
        if status != "dead":
            if kind != "error":
                status, fails, oks, until = "healthy", 0, oks + 1, None
            else:
                code = {0: 404, 1: 429}.get(k[event] % 10, 500)
                fails, oks = fails + 1, 0
                if status == "probation":
                    status = "dead"
                elif code == 404:
                    status, until = "quarantined", ts + 7 * DAY
                elif code == 429:
                    status, until = "rate_limited", ts + timedelta(minutes=5)
                elif fails >= 5:
                    status, until = "cooldown", ts + timedelta(minutes=min(360, 5 * 2 ** (fails - 5)))
                else:
                    status = "degraded"
        state[user] = (status, fails, oks, code, until)
        want[user] = (status, fails, oks)
    for name in ("r7_health_fsm", "r7_stream_health"):
        found = {r.source_id: (r.status, r.consecutive_failures, r.consecutive_successes) for r in QUERIES[name](spark, SF).collect()}
        assert found == want, name


def test_walks_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2]), i, rng.choice([0.05, 0.3, -0.2, -0.1, 0.0])) for i in range(4000)]
    want = {}
    for key, _, a in rows:
        want[key] = min(1.0, max(0.0, want.get(key, 0.5) + a))
    table = spark.createDataFrame(rows, "key int, t int, a double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.key: r.value for r in folds.clamped_walks(table, "key", ["t"], F.col("a"), 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == pytest.approx(want)

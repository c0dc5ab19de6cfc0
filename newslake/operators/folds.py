"""Ordered folds by key (P9, S18, R7-R11, R14, C9, W4): state machines over a table's rows.

Rows go to their key's task in order and pass through it in Arrow batches, so memory holds one batch
and one state, however many rows a key has. The same step functions serve keyed streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict[str, Any], Any], dict[str, Any]]


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict[str, Any]], step: Step, schema: str) -> DataFrame:
    """One row out for each row in: what ``step(state, row)`` returns, the state being changed in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    now, state = k, start()
                out.append(step(state, row))
            if out:
                yield pd.DataFrame(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def last_state(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict[str, Any]], step: Step, schema: str) -> DataFrame:
    """The last output of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, start(), None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    if out is not None:
                        done.append(out)
                    now, state = k, start()
                out = step(state, row)
            if done:
                yield pd.DataFrame(done)
        if out is not None:
            yield pd.DataFrame([out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


HEALTH_SCHEMA = "source_id bigint, status string, consecutive_failures int, consecutive_successes int, last_status_code int, cooldown_until timestamp"


def health_start() -> dict[str, Any]:
    return {"status": "healthy", "fails": 0, "oks": 0, "code": None, "until": None}


def health_step(state: dict[str, Any], row: Any) -> dict[str, Any]:
    """The source's state after an attempt; ``row`` has source_id, ts, success, status_code."""
    now: datetime = row.ts
    if state["status"] == "quarantined" and state["until"] is not None and now >= state["until"]:
        state["status"] = "probation"
    if state["status"] != "dead":
        if row.success:
            state.update(status="healthy", fails=0, oks=state["oks"] + 1, until=None)
        else:
            state.update(fails=state["fails"] + 1, oks=0, code=int(row.status_code))
            if state["status"] == "probation":
                state["status"] = "dead"
            elif row.status_code in (404, 410):
                state.update(status="quarantined", until=now + timedelta(days=7))
            elif row.status_code == 429:
                state.update(status="rate_limited", until=now + timedelta(seconds=getattr(row, "retry_after_sec", None) or 300))
            elif state["fails"] >= 5:
                state.update(status="cooldown", until=now + timedelta(minutes=min(360, 5 * 2 ** min(state["fails"] - 5, 20))))
            else:
                state["status"] = "degraded"
    return {"source_id": row.source_id, "status": state["status"], "consecutive_failures": state["fails"], "consecutive_successes": state["oks"], "last_status_code": state["code"], "cooldown_until": state["until"]}


#: Legal moves of a discovered source.
MOVES = {"discovered": {"testing", "rejected"}, "testing": {"approved", "rejected", "probation"}, "probation": {"approved", "rejected"}, "approved": {"active", "retired"}, "active": {"retired", "probation"}, "rejected": set(), "retired": set()}


def discovery_step(state: dict[str, Any], row: Any) -> dict[str, Any]:
    """A move if it is legal, else an error; ``row`` has key and target_state."""
    legal = row.target_state in MOVES[state["status"]]
    before = state["status"]
    if legal:
        state["status"] = row.target_state
    return {"key": row.key, "event_id": row.event_id, "before": before, "after": state["status"], "legal": legal}


def bucket_step(state: dict[str, Any], row: Any, rate: float, size: float, cost: float = 1.0) -> dict[str, Any]:
    """A token bucket of ``size`` that refills by ``rate`` a second; ``retry`` is the wait for a refused call."""
    now = row.ts.timestamp()
    if state["at"] is None:
        state.update(tokens=size, at=now)
    state["tokens"] = min(size, state["tokens"] + max(0.0, now - state["at"]) * rate)
    state["at"] = max(state["at"], now)
    allowed = state["tokens"] >= cost
    if allowed:
        state["tokens"] -= cost
    return {"key": row.key, "event_id": row.event_id, "allowed": allowed, "retry_after": 0.0 if allowed else round((cost - state["tokens"]) / rate, 3)}


def hourly_step(state: dict[str, Any], row: Any, limit: int) -> dict[str, Any]:
    """At most ``limit`` alerts sent in any trailing hour."""
    now = row.ts.timestamp()
    state["sent"] = [t for t in state["sent"] if t > now - 3600]
    sent = len(state["sent"]) < limit
    if sent:
        state["sent"].append(now)
    return {"key": row.key, "event_id": row.event_id, "sent": sent}


def cache_step(state: dict[str, Any], row: Any, size: int, ttl: float) -> dict[str, Any]:
    """A least-recently-used cache with a time to live; was this look-up a hit?"""
    now, held = row.ts.timestamp(), state["held"]
    at = held.pop(row.item, None)
    hit = at is not None and now - at <= ttl
    held[row.item] = at if hit else now
    while len(held) > size:
        held.pop(next(iter(held)))
    return {"key": row.key, "event_id": row.event_id, "hit": hit}


def lease_step(state: dict[str, Any], row: Any, ttl: float) -> dict[str, Any]:
    """A lease goes to its holder or, once expired, to the next that asks, with a higher fencing token."""
    now = row.ts.timestamp()
    free = state["holder"] is None or now >= state["until"]
    won = free or state["holder"] == row.worker
    if free and state["holder"] != row.worker:
        state["token"] += 1
    if won:
        state.update(holder=row.worker, until=now + ttl)
    return {"key": row.key, "event_id": row.event_id, "acquired": bool(won), "token": state["token"]}


def clamped_walks(rows: DataFrame, key: str, order: list[str], step: Column, start: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """For each key the end of a walk from ``start`` by the rows' steps in order, held within bounds after each: key, value.

    A step is x -> min(high, max(low, x + a)), and steps compose to x -> min(h, max(l, x + a)). So rows are dealt by
    ranges of (key, order), a frequent key over many tasks; each gives the three numbers of its part of the walk, and
    the parts of a key are applied in turn.
    """

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, held = TaskContext.get().partitionId(), None, (0.0, low, high)
        for batch in batches:
            done = []
            for k, a in zip(batch["key"].tolist(), batch["step"].tolist()):
                if k != now:
                    if now is not None:
                        done.append((now, part, *held))
                    now, held = k, (0.0, low, high)
                total, least, most = held
                held = total + a, min(high, max(low, least + a)), min(high, max(low, most + a))
            if done:
                yield pd.DataFrame(done, columns=["key", "part", "total", "least", "most"])
        if now is not None:
            yield pd.DataFrame([(now, part, *held)], columns=["key", "part", "total", "least", "most"])

    places = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    dealt = rows.select(F.col(key).alias("key"), step.cast("double").alias("step"), *places).filter("key IS NOT NULL AND step IS NOT NULL")
    names = ["key", *(f"o{i}" for i in range(len(order)))]
    kind = rows.schema[key].dataType.simpleString()
    parts = dealt.repartitionByRange(*names).sortWithinPartitions(*names).select("key", "step").mapInPandas(compose, f"key {kind}, part int, total double, least double, most double")
    walk = F.aggregate(F.array_sort("parts"), F.lit(float(start)), lambda x, p: F.least(p["most"], F.greatest(p["least"], x + p["total"])))
    return parts.groupBy("key").agg(F.collect_list(F.struct("part", "total", "least", "most")).alias("parts")).select(F.col("key").alias(key), walk.alias("value"))

"""Events that articles join (C1, R12) and titles that were seen (J7, D1, D2), kept between batches.

Both keep their state as ``Segments``: a batch reads what it can meet, writes what it changes and commits once, so that a
batch that runs again changes nothing, whether it failed before its commit or after.

``EventStore`` holds events with their founder's shingles, tags and last article. A batch is hydrated with the events
that are open at its first article; articles and events of one component of the shingle graph are folded in order of
time, and a component falls apart where nothing is open. Batches in order of time give the same events as one fold over all.

``TitleIndex`` holds accepted titles and, by shingle, the few shingles of each that a similar title must share
(prefix filtering under a fixed order: longer shingles, which are rarer, first). A batch is joined with those alone; the
index is never joined with itself. The newest ``cap`` titles stay, older ones go at commits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newslake.functions import text as T
from newslake.lake import forgotten, written
from newslake.operators import dedup
from newslake.operators.graph import components
from newslake.operators.segments import Segments

EVENT = "event bigint, set array<string>, tags array<string>, last timestamp, founded timestamp, since bigint, version bigint"
MEMBER = "id bigint, event bigint, similarity double, action string, at timestamp"
FOLDED = "kind int, id bigint, event bigint, similarity double, action string, set array<string>, tags array<string>, last timestamp, founded timestamp, since bigint"


def folded(rows: DataFrame, threshold: float, bonus: float, window_hours: float, version: int = 0) -> DataFrame:
    """The fold of each (part, pause) over its open events (kind 0), then its articles (kind 1), in order.

    ``rows``: part, pause, kind, since, at, id, set, tags, last. Gives an article's event (kind 1) and each event that it
    founded or changed (kind 0). Articles of a part come in order of time; of events equally like an article the first founded wins.
    """
    width = pd.Timedelta(hours=window_hours)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, events, held, founded = None, {}, {}, 0
        out: list[tuple] = []

        def closed(k: int) -> None:
            e = events.pop(k)
            for w in e["words"]:
                held[w].discard(k)
            if e["changed"]:
                out.append((0, e["id"], e["id"], 0.0, "", sorted(e["words"]), sorted(e["tags"]), e["last"], e["founded"], e["since"]))

        def opened(row: Any, since: int, changed: bool) -> None:
            nonlocal founded
            k, founded = founded, founded + 1
            events[k] = {"id": row.id, "words": set(row.set), "tags": {str(t).lower() for t in row.tags if t is not None}, "last": row.last, "founded": row.at, "since": since, "changed": changed}
            for w in events[k]["words"]:
                held.setdefault(w, set()).add(k)

        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.part, row.pause) != now:
                    for k in list(events):
                        closed(k)
                    now, held = (row.part, row.pause), {}
                if not row.kind:
                    opened(row, row.since, False)
                    continue
                words, tags = set(row.set), {str(t).lower() for t in row.tags if t is not None}
                shared: dict[int, int] = {}
                for w in words:
                    for k in held.get(w, ()):
                        shared[k] = shared.get(k, 0) + 1
                best, sim = None, 0.0
                for k in sorted(shared):  # in order of founding: of equals the first stays
                    e = events[k]
                    if row.at - e["last"] > width:  # closed, and articles come in order of time
                        closed(k)
                        continue
                    s = shared[k] / (len(words) + len(e["words"]) - shared[k]) + (bonus if tags & e["tags"] else 0.0)
                    if s > sim:
                        best, sim = e, s
                if best is not None and sim >= threshold:
                    best["last"] = max(best["last"], row.at)
                    best["tags"] |= tags
                    best["changed"] = True
                    out.append((1, row.id, best["id"], round(sim, 6), "merged_existing", None, None, None, None, None))
                else:
                    opened(row, version, True)
                    out.append((1, row.id, row.id, 0.0, "created_new", None, None, None, None, None))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=_FOLDED)
                out.clear()
        for k in list(events):
            closed(k)
        if out:
            yield pd.DataFrame(out, columns=_FOLDED)

    dealt = rows.select("part", "pause", "kind", "since", "at", "id", "set", "tags", "last").repartition("part", "pause")
    return dealt.sortWithinPartitions("part", "pause", "kind", "since", "at", "id").mapInPandas(run, FOLDED)


_FOLDED = [f.split()[0] for f in FOLDED.split(", ")]


def parted(rows: DataFrame, least: float, window_hours: float) -> DataFrame:
    """``rows`` (kind, id, set, at, last and more) with part and pause: those of different ones never meet.

    Parts are components of sets with a Jaccard of ``least``; a part pauses before an article to which no earlier one and no event is open.
    """
    keyed = written(rows.withColumn("key", F.sha2(F.array_join("set", "\u0001"), 256)))
    first = written(keyed.groupBy("key").agg(F.min("id").alias("class"), F.first("set").alias("of")))
    pairs = dedup.similar_pairs(first.select(F.col("class").alias("id"), F.col("of").alias("set")), least)
    found = written(components(pairs.select("a", "b")))
    full = keyed.join(first.select("key", "class"), "key").join(found, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("root", "class")).drop("key", "class", "node", "root")
    order = Window.partitionBy("part").orderBy("kind", "at", "id")
    reach = F.max(F.unix_micros("last")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("opens", (F.col("kind") == 1) & F.coalesce(F.unix_micros("at") - reach > window_hours * 3.6e9, F.lit(False)))
    return full.withColumn("pause", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


class EventStore:
    """Events kept at ``path``; ``add`` lets a batch of articles join or found them."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.55, bonus: float = 0.10, window_hours: float = 48.0):
        self.parts, self.threshold, self.bonus, self.window = Segments(spark, path), threshold, bonus, window_hours

    def events(self, entries: list[dict] | None = None) -> DataFrame:
        """The last state of each event."""
        entries = self.parts.state()[1] if entries is None else entries
        rows = self.parts.read(entries, "events", EVENT)
        last = rows.groupBy("event").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "event")), "version").alias("e"))
        return last.select("event", "e.*")

    def members(self) -> DataFrame:
        """id, event, similarity, action and time of every article."""
        return self.parts.read(self.parts.state()[1], "members", MEMBER)

    def add(self, rows: DataFrame) -> DataFrame:
        """The events of articles ``rows`` (id, title, tags, discovered_at): id, event, similarity, action. Articles known by id stay as they are.

        Rows without an id or a time take no part; of rows that repeat an id the first by time, then title, counts.
        """
        version, entries = self.parts.state()
        rows = rows.filter("id IS NOT NULL AND discovered_at IS NOT NULL").groupBy("id").agg(F.min(F.struct("discovered_at", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("r"))
        batch = written(rows.select("id", F.array_sort(T.shingles(F.col("r.title"))).alias("set"), "r.tags", F.col("r.discovered_at").alias("at")))
        span = batch.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
        if span.first is None or span["first"] is None:
            return self.members().filter("false").drop("at")
        known = self.parts.read(entries, "members", MEMBER).filter(F.col("at").between(span["first"], span["last"]))
        known = written(known.join(batch.select("id"), "id", "left_semi"))
        new = batch.join(known.select("id"), "id", "left_anti")
        opened = self.events(entries).filter(F.unix_micros("last") >= F.lit(span["first"]).cast("timestamp").cast("double") * 1_000_000 - self.window * 3.6e9)
        none = F.lit(0).cast("bigint")
        both = new.select(F.lit(1).alias("kind"), "id", "set", "tags", "at", F.col("at").alias("last"), none.alias("since")).unionByName(
            opened.select(F.lit(0).alias("kind"), F.col("event").alias("id"), "set", "tags", F.col("founded").alias("at"), "last", "since"))
        out = written(folded(parted(both, self.threshold - self.bonus, self.window), self.threshold, self.bonus, self.window, version + 1))
        joined = out.filter("kind = 1").select("id", "event", "similarity", "action")
        changed = out.filter("kind = 0").select("event", "set", "tags", "last", "founded", "since", F.lit(version + 1).cast("bigint").alias("version"))
        told = written(joined.join(batch.select("id", "at"), "id"))
        self.parts.commit(version, [*entries, self.parts.stored(changed, "events"), self.parts.stored(told, "members")])
        forgotten(batch, out)
        return told.drop("at").unionByName(known.drop("at"))

    def expired(self, now: Any) -> int:
        """Forget events that are closed at ``now`` and earlier states of the others; the new version. Members stay."""
        version, entries = self.parts.state()
        kept = self.events(entries).filter(F.unix_micros("last") >= F.unix_micros(F.lit(now).cast("timestamp")) - self.window * 3.6e9)
        stored = self.parts.stored(kept.select(*(f.split()[0] for f in EVENT.split(", "))), "events")
        return self.parts.commit(version, [e for e in entries if e["kind"] != "events"] + [stored])

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add each micro-batch of a stream of articles; one that runs again after a crash changes nothing."""
        return stream.writeStream.foreachBatch(lambda rows, _: self.add(rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TITLE = "id bigint, set array<string>, version bigint"
PREFIX = "m bigint, id bigint, n int, k int, prev bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, version bigint"
DECISION = "id bigint, accepted boolean, matched_id bigint, similarity double"


class TitleIndex:
    """Accepted titles kept at ``path``; ``add`` decides a batch in order of id as ``dedup.greedy`` does."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.70, cap: int | None = 20_000):
        self.parts, self.threshold, self.cap = Segments(spark, path), threshold, cap

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        """``dedup.prefix_rows`` under the fixed order: of the first members of each set a similar one has one among its own."""
        ordered = F.transform(F.array_sort(F.transform("set", lambda m: F.struct((-F.size(F.split(m, " "))).alias("words"), F.xxhash64(m).alias("hash")))), lambda x: x["hash"])
        return dedup.prefix_rows(sets.select("id", ordered.alias("ms")), self.threshold)

    def _live(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        """Titles that the cap has not taken: what comes at or after the floor, in order of commits and ids."""
        floor = max((tuple(e["floor"]) for e in entries if e.get("floor")), default=None)
        return rows if floor is None else rows.filter((F.col("version") > floor[0]) | ((F.col("version") == floor[0]) & (F.col("id") >= floor[1])))

    def titles(self) -> DataFrame:
        entries = self.parts.state()[1]
        return self._live(self.parts.read(entries, "titles", TITLE), entries)

    def evaluated(self, sets: DataFrame, entries: list[dict]) -> DataFrame:
        """D1, read only: class, other, sim: titles of the index similar to ``sets`` (id, set)."""
        held = self._live(self.parts.read(entries, "prefixes", PREFIX), entries)
        candidates = dedup.side(self._prefixes(sets), "a").join(dedup.side(held, "b"), "m").filter(dedup.may_be_similar(self.threshold)).select(F.col("a").alias("class"), F.col("b").alias("other")).distinct()
        other = self._live(self.parts.read(entries, "titles", TITLE), entries).select(F.col("id").alias("other"), F.col("set").alias("theirs"))
        full = candidates.join(other, "other").join(sets.select(F.col("id").alias("class"), "set"), "class")
        return full.withColumn("sim", T.jaccard(F.col("set"), F.col("theirs"))).filter(F.col("sim") >= self.threshold - 1e-12).select("class", "other", "sim")

    def add(self, rows: DataFrame, passed: Column | None = None) -> DataFrame:
        """Decide ``rows`` (id, title) in order of id and keep the accepted: id, accepted, matched_id, similarity.

        A title is rejected for a similar one that is in the index or was accepted earlier in the batch; the most similar is told, of equals one of
        the index, then the smallest id. Rows whose id was decided before keep that decision. Rows that ``passed`` refuses are decided but not
        kept (D2), nor do they reject others of the batch. Titles without a word are accepted and not kept; a null id takes no part.
        """
        version, entries = self.parts.state()
        rows = rows.withColumn("_passed", F.lit(True) if passed is None else F.coalesce(passed, F.lit(False)))
        rows = written(rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("title", "_passed")).alias("r")).select("id", "r.title", F.col("r._passed").alias("passed")))
        known = written(self.parts.read(entries, "decisions", DECISION).join(rows.select("id"), "id", "left_semi"))
        new = written(rows.join(known.select("id"), "id", "left_anti"))
        # of equal titles those that may be kept come first: the others are like the first of them
        marked = new.select("id", "title")
        own = written(dedup.classes(marked, "id", "title").join(new.select("id", "passed"), "id"))
        heads = written(own.filter(F.size("set") > 0).groupBy("class").agg(F.first("set").alias("set"), F.min(F.when(F.col("passed"), F.col("id"))).alias("first")))
        sets = heads.select(F.col("class").alias("id"), "set")
        hits = written(self.evaluated(sets, entries))
        # who may reject others: the first passed row of each class without a hit, in order of that row's id
        free = written(heads.join(hits.select("class"), "class", "left_anti").filter("first IS NOT NULL").select("class", F.col("first").alias("rank")))
        nodes = written(heads.select("class").join(free, "class", "left").select(F.col("class").alias("id"), "rank"))
        accepted, edges = dedup.settled_on_demand(nodes, dedup.similar_candidates(sets, self.threshold), lambda pairs: dedup.similar_judged(pairs, sets, self.threshold))
        ok = written(accepted.select(F.col("node").alias("class")).join(free.select("class", F.col("rank").alias("first")), "class"))
        near = edges.select(F.col("b").alias("class"), F.col("a").alias("of"), "sim").union(edges.select(F.col("a").alias("class"), F.col("b").alias("of"), "sim")).union(heads.select("class", F.col("class").alias("of"), F.lit(1.0).alias("sim")))
        near = written(near.join(ok.select(F.col("class").alias("of"), F.col("first").alias("other")), "of").select("class", "other", "sim"))
        there = own.join(hits, "class").select("id", "other", "sim", F.lit(0).alias("place"))
        here = own.join(near, "class").filter(F.col("other") < F.col("id")).select("id", "other", "sim", F.lit(1).alias("place"))
        best = there.unionByName(here).groupBy("id").agg(F.min_by(F.struct("other", "sim"), F.struct((-F.col("sim")).alias("s"), "place", "other")).alias("m"))
        told = written(new.select("id", "passed").join(best, "id", "left").select("id", F.col("m").isNull().alias("accepted"), F.col("m.other").alias("matched_id"), F.round("m.sim", 6).alias("similarity"), "passed"))
        kept = written(told.filter("accepted AND passed").select("id").join(own.filter(F.size("set") > 0).select("id", "set"), "id").withColumn("version", F.lit(version + 1).cast("bigint")))
        titles = self.parts.stored(kept, "titles")
        prefixes = self.parts.stored(self._prefixes(kept).withColumn("version", F.lit(version + 1).cast("bigint")), "prefixes")
        decisions = self.parts.stored(told.drop("passed"), "decisions")
        entries = self._capped([*entries, titles, prefixes, decisions])
        self.parts.commit(version, entries)
        forgotten(rows, new, own, heads, hits, free, nodes, ok, near, kept)
        return told.drop("passed").unionByName(known)

    def _capped(self, entries: list[dict]) -> list[dict]:
        """The entries with the floor that leaves the newest ``cap`` titles."""
        if not self.cap:
            return entries
        live = self._live(self.parts.read(entries, "titles", TITLE), entries).select("version", "id")
        over = live.count() - self.cap
        if over <= 0:
            return entries
        floor = live.orderBy("version", "id").limit(over + 1).agg(F.max(F.struct("version", "id")).alias("f")).first().f
        return [*entries[:-1], entries[-1] | {"floor": [floor.version, floor.id]}]


"""Duplicates and events among articles."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from newslake.functions import text as T
from newslake.functions.arrays import groups_of, mix64
from newslake.lake import forgotten, written
from newslake.operators import ratios


def hashed(members: Column) -> Column:
    """Members as 64-bit hashes, which candidates meet by: two members that share one are a candidate more at most."""
    return F.transform(members, lambda m: F.xxhash64(m))


def sketch(members: Column) -> list[Column]:
    """256 bits of a set of hashes, as four numbers: sets that differ in many bits cannot share much."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))
    none = F.lit(0).cast("bigint")
    return [F.aggregate(members, none, lambda o, x: o.bitwiseOR(F.when(F.shiftright(x, 6).bitwiseAND(3) == w, bit(x)).otherwise(none))).alias(f"s{w}") for w in range(4)]  # noqa: B023


#: What a member of a prefix is kept with: its set's size, its own place, the member before it and the set's sketch.
PLACE = ["n", "k", "prev", "s0", "s1", "s2", "s3"]


def prefix_rows(ordered: DataFrame, threshold: float) -> DataFrame:
    """m, id and ``PLACE`` from rows (id, ms: hashes in an order that all sets share): the first n - ceil(t * n) + 1 members."""
    n = F.size("ms")
    held = ordered.select("id", "ms", n.alias("n"), *sketch(F.col("ms")))
    first = F.slice("ms", 1, (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
    each = F.transform(first, lambda m, i: F.struct(m.alias("m"), (i + 1).cast("int").alias("k"), F.when(i > 0, F.get("ms", i - 1)).alias("prev")))
    return held.select("id", "n", "s0", "s1", "s2", "s3", F.explode(each).alias("e")).select("e.m", "id", "n", "e.k", "e.prev", "s0", "s1", "s2", "s3")


def side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("m", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in PLACE))


def may_be_similar(threshold: float) -> Column:
    """Of two sides a and b that share a member: whether sizes, places and sketches allow ``threshold``, at their first shared member or a few more."""
    least = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    fit = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9)
    # the first shared member leaves enough behind it in both sets
    fit &= 1 + F.least(F.col("n_a") - F.col("k_a"), F.col("n_b") - F.col("k_b")) >= least
    apart = sum((F.bit_count(F.col(f"s{w}_a").bitwiseXOR(F.col(f"s{w}_b"))) for w in range(4)), F.lit(0))
    fit &= (F.col("n_a") + F.col("n_b") - apart) / 2 >= least
    # where the members before are one, the pair was met there
    return fit & ~F.coalesce(F.col("prev_a") == F.col("prev_b"), F.lit(False))


def rare_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``prefix_rows`` of sets (id, set) by falling rarity, without members that one set alone has."""
    members = sets.select("id", F.explode(hashed(F.col("set"))).alias("m"))
    rare = members.groupBy("m").agg(F.count("*").alias("df"))
    ordered = members.join(rare, "m").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("of"))
    rows = prefix_rows(ordered.select("id", F.transform("of", lambda x: x["m"]).alias("ms")), threshold)
    return rows.join(rare.filter("df > 1").select("m"), "m", "left_semi")


def similar_candidates(rows: DataFrame, threshold: float, id_column: str = "id", set_column: str = "set") -> DataFrame:
    """Pairs (a, b), a < b, among which are all of ``similar_pairs``.

    Two similar sets share one of their rarest members: those in the first n - ceil(t * n) + 1 by falling
    rarity. Only these are joined. ``rows`` has each set once.
    """
    first = written(rare_prefixes(rows.select(F.col(id_column).alias("id"), F.col(set_column).alias("set")).filter(F.size("set") > 0), threshold))
    return side(first, "a").join(side(first, "b"), "m").filter((F.col("a") < F.col("b")) & may_be_similar(threshold)).select("a", "b").distinct()


def similar_judged(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets (id, set) have a Jaccard of at least ``threshold``, with it as sim."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return full.withColumn("sim", T.jaccard(F.col("sa"), F.col("sb"))).filter(F.col("sim") >= threshold - 1e-12).select("a", "b", "sim")


def similar_pairs(rows: DataFrame, threshold: float, id_column: str = "id", set_column: str = "set") -> DataFrame:
    """Pairs (a, b, sim), a < b, of distinct sets with a Jaccard of at least ``threshold`` (J6, J7): candidates, then whole sets."""
    sets = written(rows.select(F.col(id_column).alias("id"), F.col(set_column).alias("set")).filter(F.size("set") > 0))
    return similar_judged(written(similar_candidates(sets, threshold)), sets, threshold)


def classes(rows: DataFrame, id_column: str, title_column: str, members: Callable[[Column], Column] = T.shingles) -> DataFrame:
    """Rows with their sorted title shingles (or other ``members``) and the class (smallest id) of equal sets: id, set, class."""
    sets = rows.select(F.col(id_column).alias("id"), F.array_sort(members(F.col(title_column))).alias("set")).withColumn("key", F.sha2(F.array_join("set", "\u0001"), 256))
    sets = written(sets)
    first = sets.groupBy("key").agg(F.min("id").alias("class"))
    return sets.join(written(first), "key").select("id", "set", "class")


def greedy(rows: DataFrame, id_column: str = "id", title_column: str = "title", threshold: float = 0.70, members: Callable[[Column], Column] = T.shingles) -> DataFrame:
    """In order of id, a title is accepted unless an accepted earlier one is similar.

    Columns id, accepted, matched_id, similarity: the most similar accepted earlier id, the earliest of
    equals. Rows of equal titles decide together: the first of them as if alone, and the others are like
    it. Titles without a word are always accepted. Rounds settle what has no open earlier neighbour.
    """
    own = written(classes(rows, id_column, title_column, members))
    heads = own.filter((F.col("id") == F.col("class")) & (F.size("set") > 0))
    ok, edges = settled_on_demand(heads.select("id", F.col("id").alias("rank")), similar_candidates(heads, threshold), lambda pairs: similar_judged(pairs, heads, threshold))
    return told(own.select("id", "class"), heads.select("id"), ok, edges)


def settled(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns node, ok: in order of node, each of ``heads`` (id) is accepted unless an accepted earlier one has an edge to it.

    ``edges`` has a, b with a < b. Rounds settle what has no open earlier neighbour.
    """
    state = written(heads.select(F.col("id").alias("node"), F.lit(None).cast("boolean").alias("ok")))
    while True:
        a = state.select(F.col("node").alias("a"), F.col("ok").alias("a_ok"))
        seen = edges.join(a, "a").groupBy("b").agg(F.max(F.coalesce("a_ok", F.lit(False))).alias("hit"), F.max(F.col("a_ok").isNull()).alias("open"))
        judged = state.join(seen, F.col("node") == F.col("b"), "left")
        new = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        old, state = state, written(judged.select("node", new.alias("ok")))
        forgotten(old)
        if state.filter("ok IS NULL").isEmpty():
            return state


@dataclass(frozen=True)
class Tier:
    """Rows (id, class) and the pairs (a, b) of classes that are alike; rows of one class are alike too."""

    own: DataFrame
    pairs: DataFrame | None = None

    def nearest(self, state: DataFrame) -> DataFrame:
        """id, first_ok and first_open of each row: the smallest accepted and open rows alike to it, by classes alone."""
        held = self.own.join(state, F.col("id") == F.col("node"))
        firsts = written(held.groupBy("class").agg(F.min(F.when(F.col("ok"), F.col("id"))).alias("first_ok"), F.min(F.when(F.col("ok").isNull(), F.col("id"))).alias("first_open")))
        near = firsts
        if self.pairs is not None:
            both = self.pairs.select("a", "b").union(self.pairs.select("b", "a"))
            across = both.join(firsts, F.col("a") == F.col("class")).select(F.col("b").alias("class"), "first_ok", "first_open")
            near = written(firsts.union(across).groupBy("class").agg(F.min("first_ok").alias("first_ok"), F.min("first_open").alias("first_open")))
        return self.own.join(near, "class").select("id", "first_ok", "first_open")


def settled_by(rows: DataFrame, tiers: list[Tier]) -> DataFrame:
    """``settled`` where rows are alike by any of ``tiers``: classes are aggregates, so a frequent class makes no pairs."""
    state = written(rows.select(F.col("id").alias("node"), F.lit(None).cast("boolean").alias("ok")))
    while True:
        seen = reduce(DataFrame.unionByName, (t.nearest(state) for t in tiers)).groupBy("id").agg(F.min("first_ok").alias("first_ok"), F.min("first_open").alias("first_open"))
        judged = state.join(seen, F.col("node") == F.col("id"), "left")
        earlier = lambda c: F.coalesce(F.col(c) < F.col("node"), F.lit(False))
        new = F.when(F.col("ok").isNotNull(), F.col("ok")).when(earlier("first_ok"), F.lit(False)).when(~earlier("first_open"), F.lit(True))
        old, state = state, written(judged.select("node", new.alias("ok")))
        forgotten(old)
        if state.filter("ok IS NULL").isEmpty():
            return state


def settled_on_demand(nodes: DataFrame, pairs: DataFrame, judged: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``settled`` in order of rank, where ``rounds`` judge pairs with an accepted end alone: copies of a text don't make all their pairs.

    ``nodes`` has id and rank (null: never accepted), ``pairs`` has a, b in any order, once each, and holds all pairs that are
    alike; ``judged`` gives a, b and sim of those that are. What the rounds leave, mostly pairs that are not alike, is judged at
    once. Returns the accepted (node) and pairs alike, among them all that have an accepted end.
    """
    state = written(nodes.select(F.col("id").alias("node"), "rank", F.when(F.col("rank").isNull(), F.lit(False)).alias("ok")))
    pending = written(pairs.select("a", "b"))
    edges = []
    for _ in range(rounds):
        ends = [state.select(F.col("node").alias(x), F.col("rank").alias(f"rank_{x}"), F.col("ok").alias(f"ok_{x}")) for x in "ab"]
        both = pending.join(ends[0], "a").join(ends[1], "b")
        later = F.when(F.col("rank_a") < F.col("rank_b"), F.col("b")).otherwise(F.col("a"))
        blocked = both.filter("ok_a IS NULL AND ok_b IS NULL").select(later.alias("node")).distinct().withColumn("blocked", F.lit(True))
        fresh = written(state.filter("ok IS NULL").join(blocked, "node", "left").filter("blocked IS NULL").select("node"))
        by = written(pending.join(fresh.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b", F.col("b").alias("other")).union(pending.join(fresh.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", F.col("a").alias("other"))))
        found = written(judged(by.select("a", "b")))
        edges.append(found)
        hit = found.join(by, ["a", "b"]).select(F.col("other").alias("node")).distinct().withColumn("hit", F.lit(True))
        new = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.col("fresh"), F.lit(True)).when(F.col("hit"), F.lit(False))
        old, state = state, written(state.join(fresh.withColumn("fresh", F.lit(True)), "node", "left").join(hit, "node", "left").select("node", "rank", new.alias("ok")))
        ends = [state.select(F.col("node").alias(x), F.col("ok").alias(f"ok_{x}")) for x in "ab"]
        past, pending = pending, written(pending.join(ends[0], "a").join(ends[1], "b").filter("NOT coalesce(ok_a, false) AND NOT coalesce(ok_b, false) AND (ok_a IS NULL OR ok_b IS NULL)").select("a", "b"))
        forgotten(old, past, fresh, by)
    rest = written(judged(pending))
    still = written(state.filter("ok IS NULL").select("node", "rank"))
    ends = [still.select(F.col("node").alias(x), F.col("rank").alias(f"rank_{x}")) for x in "ab"]
    between = written(rest.join(ends[0], "a").join(ends[1], "b").select(F.least("rank_a", "rank_b").alias("a"), F.greatest("rank_a", "rank_b").alias("b")))
    late = settled(still.select(F.col("rank").alias("id")), between).filter("ok").select(F.col("node").alias("rank")).join(still, "rank")
    ok = written(state.filter("ok").select("node").union(late.select("node")))
    return ok, reduce(DataFrame.unionByName, [*edges, rest])


def greedy_of(own: DataFrame, heads: DataFrame, edges: DataFrame) -> DataFrame:
    """``greedy`` for any likeness: ``own`` has id and class (its smallest id), ``heads`` the classes that may have edges.

    Rows of a class decide together and are like their head; ``edges`` has a, b and sim between heads.
    """
    return told(own, heads, settled(heads.select("id"), edges).filter("ok").select("node"), edges)


def told(own: DataFrame, heads: DataFrame, ok: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``greedy`` where ``ok`` (node) are the accepted heads; ``edges`` are all with such an end."""
    # accepted earlier neighbours of a class, its own head among them
    near = edges.select(F.col("b").alias("class"), F.col("a").alias("other"), "sim").union(edges.select(F.col("a").alias("class"), F.col("b").alias("other"), "sim"))
    near = near.union(heads.select(F.col("id").alias("class"), F.col("id").alias("other"), F.lit(1.0).alias("sim")))
    near = written(near.join(ok, F.col("other") == F.col("node")).select("class", "other", "sim"))
    best = own.join(near, "class").filter(F.col("other") < F.col("id")).groupBy("id").agg(F.min_by(F.struct("other", "sim"), F.struct((-F.col("sim")).alias("s"), "other")).alias("m"))
    return own.select("id").join(best, "id", "left").select("id", F.col("m").isNull().alias("accepted"), F.col("m.other").alias("matched_id"), F.round("m.sim", 6).alias("similarity"))


def ratio_candidates(titles: DataFrame, threshold: float, length_share: float = 1.0) -> DataFrame:
    """Pairs (a, b), a < b, among which are all of ``ratio_pairs``; ``titles`` has id and title."""
    sized = written(titles.select(F.col("id").cast("bigint").alias("id"), "title", F.length("title").alias("n")).filter("n > 0"))
    return ratios.candidates(sized, threshold, max(threshold / (2 - threshold), 1 - length_share))


def ratio_judged(pairs: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose matching-block ratio exceeds ``threshold``, with it as sim."""
    full = pairs.join(titles.select(F.col("id").alias("a"), F.col("title").alias("x")), "a").join(titles.select(F.col("id").alias("b"), F.col("title").alias("y")), "b")
    return full.select("a", "b", matching_ratio(F.col("x"), F.col("y")).alias("sim")).filter(F.col("sim") > threshold)


def ratio_pairs(rows: DataFrame, threshold: float, length_share: float = 1.0) -> DataFrame:
    """Pairs (a, b, sim), a < b, of distinct titles (id, title) whose matching-block ratio exceeds ``threshold``.

    ``length_share``: the most that lengths may differ by, of the longer. Candidates come from ``ratios``.
    """
    titles = written(rows.select("id", "title"))
    return ratio_judged(written(ratio_candidates(titles, threshold, length_share)), titles, threshold)


@F.pandas_udf(DoubleType())
def matching_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, as Python's difflib counts them."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y)], dtype=float)


def edit_dedup(rows: DataFrame, threshold: float = 0.85, length_share: float = 0.20) -> DataFrame:
    """As ``greedy`` over rows (id in order of reading, title): earlier titles of like length and a ratio above ``threshold``."""
    low = written(rows.select("id", F.lower(F.trim("title")).alias("title")))
    first = written(low.groupBy("title").agg(F.min("id").alias("class")))
    own = written(low.join(first, "title").select("id", "class", "title"))
    heads = own.filter("id = class AND title <> ''").select("id", "title")
    near = ratio_candidates(heads, threshold, length_share)
    ok, edges = settled_on_demand(heads.select("id", F.col("id").alias("rank")), near, lambda pairs: ratio_judged(pairs, heads, threshold))
    return told(own.select("id", "class"), heads, ok, edges)


def minhash_gate(rows: DataFrame, threshold: float = 0.80) -> DataFrame:
    """As ``greedy`` over texts (id, words) by signatures of 64 permutations modulo 2^61 - 1 over MD5 of word runs."""
    signed = written(minhash(rows, 64, family="md5"))
    first = written(signed.groupBy("sig").agg(F.min("id").alias("class")))
    own = written(signed.join(first, "sig").select("id", "class"))
    edges = written(minhash_pairs(rows, threshold, signed=signed).join(own.filter("id = class").select(F.col("id").alias("b")), "b").select("a", "b", F.col("estimate").alias("sim")))
    return greedy_of(own, own.filter("id = class").select("id"), edges)


def three_tiers(rows: DataFrame, title_ratio: float = 0.90, content: float = 0.80, least_chars: int = 50) -> DataFrame:
    """D3: rows (id, url, title, body) in order of id against accepted earlier ones: by address, then title, then content.

    Content of ``least_chars`` and more is compared by signatures, shorter by equality. Columns id, accepted, and the
    first tier that rejects: url, title or content.
    """
    rows = written(rows.select("id", "url", F.lower(F.trim("title")).alias("title"), F.coalesce("body", F.lit("")).alias("body")))
    titled = rows.filter("title <> ''")
    first = written(titled.groupBy("title").agg(F.min("id").alias("class")))
    long = rows.filter(F.length("body") >= least_chars).select("id", T.words(F.col("body")).alias("words"))
    signed = written(minhash(long, 64))
    alike = written(signed.groupBy("sig").agg(F.min("id").alias("class")))
    short = rows.filter((F.length("body") < least_chars) & (F.col("body") != ""))
    same = written(short.groupBy("body").agg(F.min("id").alias("class")))
    near = minhash_pairs(long, content, signed=signed).join(alike.select(F.col("class").alias("b")), "b").select("a", "b")
    addresses = written(rows.filter("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("class")))
    tiers = {
        "url": Tier(written(rows.join(addresses, "url").select("id", "class"))),
        "title": Tier(written(titled.join(first, "title").select("id", "class")), written(ratio_pairs(first.select(F.col("class").alias("id"), "title"), title_ratio - 1e-12).select("a", "b"))),
        "content": Tier(written(signed.join(alike, "sig").select("id", "class").union(short.join(same, "body").select("id", "class"))), written(near)),
    }
    ok = settled_by(rows, list(tiers.values()))
    hits = reduce(DataFrame.unionByName, (t.nearest(ok).filter("first_ok < id").select("id", F.lit(i).alias("rank"), F.lit(name).alias("tier")) for i, (name, t) in enumerate(tiers.items())))
    told = written(hits.groupBy("id").agg(F.min_by("tier", "rank").alias("tier")))
    return rows.select("id").join(told, "id", "left").select("id", F.col("tier").isNull().alias("accepted"), "tier")


def committed(index: DataFrame, evaluated: DataFrame, cap: int = 20_000) -> DataFrame:
    """The index (id, key, at) with the rows of ``evaluated`` that passed and were accepted; the newest ``cap`` stay.

    A row whose id is there already changes nothing, so a commit may run again.
    """
    new = evaluated.filter("passed AND accepted").select("id", "key", "at").dropDuplicates(["id"])
    every = index.unionByName(new.join(index.select("id"), "id", "left_anti"))
    return every.orderBy(F.desc("at"), F.desc("id")).limit(cap)


def clusters(rows: DataFrame, threshold: float = 0.55, bonus: float = 0.10, window_hours: float = 48.0) -> DataFrame:
    """Each article joins the active event most like it, or founds one: id, event (founder's id), similarity, action.

    ``rows`` has id, title, tags and discovered_at. An event keeps its founder's title, and a match
    needs a founder's Jaccard of ``threshold - bonus``; so articles of different components of that
    graph never meet. An event stays open for ``window_hours`` after its last article, so a component falls
    apart where its articles pause for longer. Each part is folded in order of (discovered_at, id), an Arrow
    batch at a time, with open events found by the shingles that they share with an article. For batches that
    follow each other see ``stories.EventStore``.
    """
    from newslake.operators import stories

    at = F.col("discovered_at")
    own = rows.select(F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("id"), F.array_sort(T.shingles(F.col("title"))).alias("set"), "tags", at.alias("at"), at.alias("last"), F.lit(0).cast("bigint").alias("since"))
    parts = stories.parted(own, threshold - bonus, window_hours)
    return stories.folded(parts, threshold, bonus, window_hours).filter("kind = 1").select("id", "event", "similarity", "action")


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column | str]) -> DataFrame:
    """The first row of each key; rows with a null key stay."""
    kept = rows
    for i, key in enumerate(keys):
        marked = kept.withColumn("_key", key)
        place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
        kept = marked.filter("_key IS NULL").drop("_key").unionByName(marked.filter("_key IS NOT NULL").withColumn("_place", place).filter("_place = 1").drop("_place", "_key"))
    return kept


def best_version(rows: DataFrame, group: Column, score: Column, order: str) -> DataFrame:
    """Of each group the row of the highest score, the first of equals."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def confidence(evidence: DataFrame) -> DataFrame:
    """event_id and confidence from rows (event_id, source_name, source_tier, is_primary, discovered_at, article_id)."""
    name = F.lower(F.trim("source_name"))
    order = Window.partitionBy("event_id").orderBy("discovered_at", "article_id")
    first = F.row_number().over(Window.partitionBy("event_id", name).orderBy("discovered_at", "article_id"))
    rows = evidence.withColumn("first", first == 1).withColumn("opening", F.row_number().over(order) == 1)
    extra = F.when(F.col("first") & ~F.col("opening"), F.when(F.col("source_tier") <= 2, 0.15).when(F.col("source_tier") == 3, 0.05).otherwise(0.0)).otherwise(0.0)
    base = F.when(F.col("best") == 1, 0.70).when(F.col("best") == 2, 0.50).when(F.col("best") == 3, 0.30).when(F.col("best") == 4, 0.15).otherwise(0.20)
    sums = rows.groupBy("event_id").agg(F.min("source_tier").alias("best"), F.max("is_primary").alias("primary"), F.sum(extra).alias("extra"), F.count("*").alias("n_sources"), F.min("discovered_at").alias("first_seen"), F.max("discovered_at").alias("last_seen"))
    score = F.least(F.lit(1.0), base + F.when(F.col("primary"), 0.05).otherwise(0.0) + F.least(F.lit(0.30), "extra"))
    return sums.select("event_id", F.round(score, 3).alias("confidence"), "n_sources", "first_seen", "last_seen")


def novelty(timeline: Column, sources: Column) -> Column:
    """C5."""
    fall = 1.0 - F.greatest(timeline - 1, F.lit(0)) * 0.15 - F.greatest(sources - 1, F.lit(0)) * 0.05
    return F.round(F.greatest(F.lit(0.20), F.least(F.lit(1.0), fall)), 3)


PRIME = np.uint64((1 << 61) - 1)


def times(x: np.ndarray, a: np.uint64) -> np.ndarray:
    """x * a modulo 2^61 - 1, for numbers below it: halves of 31 bits, and 2^61 counts as one."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    x1, x0, a1, a0 = x >> half, x & low, a >> half, a & low
    middle = x1 * a0 + x0 * a1
    total = np.uint64(2) * x1 * a1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + x0 * a0
    total = (total & PRIME) + (total >> np.uint64(61))
    return np.where(total >= PRIME, total - PRIME, total)


def minhash(rows: DataFrame, n: int = 64, run: int = 3, family: str = "mixed") -> DataFrame:
    """Id and sig, ``n`` minima of salted hashes over the runs of ``run`` words; ``rows`` has id and words (in order).

    A text of fewer words is one run, one without a word has no row. ``family``: mixed multiplies hashes modulo 2^64;
    md5 takes 64 bits of a run's MD5 through linear maps modulo 2^61 - 1.
    """
    odd, add = mix64(np.arange(1, n + 1)) | np.uint64(1), mix64(np.arange(n + 1, 2 * n + 1))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            known = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
            hashes = known[words.indices.to_numpy()]
            ends = np.cumsum(sizes)
            for i, j in groups_of(sizes.tolist(), 100_000):
                own = hashes[ends[i] - sizes[i] : ends[j - 1]]
                full = np.flatnonzero(sizes[i:j]) + i
                size = np.repeat(sizes[full], sizes[full])
                place = np.arange(len(own)) - np.repeat(np.cumsum(sizes[full]) - sizes[full], sizes[full])
                runs = mix64(own)
                for k in range(1, run):
                    runs = mix64(runs + np.where(place + k < size, np.concatenate([own[k:], own[:k]]), np.uint64(k)))
                runs = runs[place <= np.maximum(size - run, 0)]
                counts = np.maximum(sizes[full] - run + 1, 1)
                starts = np.cumsum(counts) - counts
                if family == "md5":
                    texts = lists.flatten().slice(int(ends[i] - sizes[i]), int(ends[j - 1] - ends[i] + sizes[i])).to_pylist()
                    at = np.flatnonzero(place <= np.maximum(size - run, 0))
                    stop = (at - place[at] + size[at]).tolist()
                    runs = np.array([int.from_bytes(hashlib.md5(" ".join(texts[a : min(a + run, e)]).encode()).digest()[:8], "big") for a, e in zip(at.tolist(), stop)], np.uint64) % PRIME
                    moved = lambda a, b: (times(runs, a % PRIME) + b % PRIME) % PRIME  # noqa: E731, B023
                else:
                    moved = lambda a, b: runs * a + b  # noqa: E731, B023
                least = np.stack([np.minimum.reduceat(moved(a, b), starts) for a, b in zip(odd, add)], axis=1) if len(full) else np.zeros((0, n), np.uint64)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, n), pa.int32()), pa.array(least.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), sig], names=["id", "sig"])

    return rows.select(F.col("id").cast("bigint").alias("id"), "words").mapInArrow(sign, "id bigint, sig array<bigint>")


def minhash_pairs(rows: DataFrame, threshold: float = 0.80, bands: int = 16, size: int = 4, signed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, estimate) whose signatures agree in a share of at least ``threshold``; ``rows`` has id and words.

    Rows of equal signatures are one: each is paired with the first of them.
    """
    signed = signed if signed is not None else written(minhash(rows, bands * size))
    heads = written(signed.groupBy("sig").agg(F.min("id").alias("head")))
    parts = heads.select("head", "sig", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("sig", b * size + 1, size)))).alias("band", "key"))
    a, b = parts.select(F.col("head").alias("a"), "band", "key"), parts.select(F.col("head").alias("b"), "band", "key")
    candidates = a.join(b, ["band", "key"]).filter("a < b").select("a", "b").distinct()
    full = candidates.join(heads.select(F.col("head").alias("a"), F.col("sig").alias("x")), "a").join(heads.select(F.col("head").alias("b"), F.col("sig").alias("y")), "b")
    same = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u == v), lambda e: e)) / (bands * size)
    copies = signed.join(heads, "sig").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("estimate"))
    return full.select("a", "b", same.alias("estimate")).filter(F.col("estimate") >= threshold).union(copies)

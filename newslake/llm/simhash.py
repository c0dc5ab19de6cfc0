"""SimHash near-duplicates through vantage-point trees over fingerprints.

Fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of their upper or their lower
half, so two forests each search one half with radius 1; a link is accepted on all 64 bits. A tree
splits at a vantage point v and a distance m: points with d <= m go left and points with d > m - radius
go right. By the triangle inequality two points within the radius of each other meet on one side at
least, so only the boundary is held twice. The upper part of a tree is built from a bounded
sample of fingerprints and divides all of them into shards; the sample moves shards' sizes, never links.
Within a shard, the tree goes on with vantage points of its own until a few hundred points remain, which
are compared in numpy. A shard gives links from each linked fingerprint to the smallest that it reaches
there, not all pairs; Spark joins then find the components.

Documents with equal fingerprints are one point from the start. Null and empty texts have fingerprint
zero and link like any other; very long texts are read whole, their shingles in runs of ``RUN``. Rows with a
null doc_id take part and never name a component unless all its rows are such. Repeated rows each return. Empty
tables give empty results; extra columns are not read, or kept whole by ``keep_one``, whatever their names.

A ball that no vantage point parts is parted by the bytes of the other half: points within 3 bits agree in one
of its four. Where more than two blocks of points agree in a byte too, each pair of blocks of ``BLOCK`` points is
a group of its own, so no task compares more than two blocks at once, whatever the ball.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newslake.llm.common import bytes_of, written
from newslake.llm.tokens import segments
from newslake.operators.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
HALF_RADIUS = RADIUS // 2
SAMPLE, LEAF = 40_000, 384
SHARD = 20_000  # wished points of a shard
BLOCK = 8192  # points of a ball's block
RUN = 1 << 16  # shingles at once


def fingerprint(text: bytes) -> int:
    """The 64 majority bits over the shingles' hashes."""
    h, seed = xxhash.xxh64_intdigest, SEED
    n, ones, tail = 0, np.zeros(64, np.int64), []

    def add(words: list[bytes], k: int) -> None:
        nonlocal n
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = ends[k - 1 :].tolist()
        hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts.tolist(), last)), np.uint64, len(last))
        ones[:] += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(last)

    for part in segments(text, 8 * RUN):  # cut at white space
        words = tail + part.lower().split()  # bytes: only A-Z, only ASCII white space
        if len(words) >= SHINGLE:
            add(words, SHINGLE)
            tail = words[1 - SHINGLE :]  # opens the next part's shingles
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        add(tail, len(tail))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x) for x in bytes_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(compute, "doc_id bigint, print bigint")


def _split(points: np.ndarray, seed: int) -> tuple[np.uint32, int] | None:
    """A vantage point and distance that hold few points twice and leave both sides well below all."""
    best, n = None, len(points)
    for k in range(4):
        v = points[(seed * 2654435761 + k * 40503) % n]
        tally = np.bincount(np.bitwise_count(points ^ v), minlength=34)
        left = np.cumsum(tally)
        for m in range(33):
            a, b = left[m], n - (left[m - HALF_RADIUS] if m >= HALF_RADIUS else 0)
            if max(a, b) <= 0.8 * n:
                # work below is about the sum of squares of both sides
                cost = float(a) ** 2 + float(b) ** 2
                if best is None or cost < best[0]:
                    best = (cost, v, m)
    return best and best[1:]


def _sides(points: np.ndarray, v: np.uint32, m: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(points ^ v)
    return np.flatnonzero(d <= m), np.flatnonzero(d > m - HALF_RADIUS)


Tree = tuple | int


def build(points: np.ndarray, size: int) -> tuple[Tree, int]:
    """A tree (vantage point, distance, left, right) or a leaf's number, and the number of leaves."""
    leaves = 0

    def grow(own: np.ndarray, seed: int) -> Tree:
        nonlocal leaves
        cut = _split(own, seed) if len(own) > size else None
        if cut is None:
            leaves += 1
            return leaves - 1
        left, right = _sides(own, *cut)
        return (*cut, grow(own[left], 2 * seed + 1), grow(own[right], 2 * seed + 2))

    return grow(points, 0), leaves


def shards_of(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point and a leaf that holds it; points on boundaries occur several times."""
    found, todo = [], [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            found.append((at, np.full(len(at), node)))
        else:
            v, m, left, right = node
            a, b = _sides(points[at], v, m)
            todo += [(left, at[a]), (right, at[b])]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Union:
    """Smallest member by index of what was linked."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.up[a] != self.up[b]
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from each member to the smallest that it reaches, but for those that are it."""
        root = np.array([self.find(i) for i in range(len(self.up))], np.int64)
        far = np.flatnonzero(root != np.arange(len(root)))
        return far, root[far]


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that join what the matrix ``near`` joins: rows to rows, then columns to rows."""
    n = len(near)
    row = np.arange(n)
    while True:
        column = np.where(near, row[:, None], n).min(axis=0, initial=n)
        new = np.minimum(row, np.where(near, column[None, :], n).min(axis=1, initial=n))
        if (new == row).all():
            break
        row = new
    far, hit = np.flatnonzero(row != np.arange(n)), np.flatnonzero(column < n)
    return far, row[far], hit, column[hit]


def block_links(own: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star links (larger, smaller index) of what differs in few bits between ``own`` and ``other``, or within ``own``.

    Indices run through ``own`` and on through ``other``.
    """
    base, other = (0, own) if other is None else (len(own), other)
    union = _Union(base + len(other))
    for i in range(0, len(own), LEAF):
        for j in range(0 if base else i, len(other), LEAF):
            near = np.bitwise_count(own[i : i + LEAF, None] ^ other[None, j : j + LEAF]) <= RADIUS
            a, b, c, d = _stars(near)
            union.link(np.concatenate([a + i, c + base + j]), np.concatenate([b + i, d + i]))
    return union.stars()


def shard_links(prints: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Star links (larger, smaller) of the distinct sorted ``prints`` (uint64) of a shard that differ in few bits.

    Then the dense groups of more than two blocks, which are left to ``dense_links``.
    """
    halves, rest = ((prints >> np.uint64(32 * k)).astype(np.uint32) for k in (half, 1 - half))
    union, dense = _Union(len(prints)), []
    todo = [(np.arange(len(prints)), 1)]
    while todo:
        at, seed = todo.pop()
        cut = _split(halves[at], seed) if len(at) > LEAF else None
        if cut is not None:
            todo += [(at[x], 2 * seed + k) for k, x in enumerate(_sides(halves[at], *cut))]
        elif len(at) <= LEAF:
            union.link(*(at[x] for x in block_links(prints[at])))
        else:
            for byte in range(4):
                value = (rest[at] >> np.uint32(8 * byte)) & np.uint32(255)
                order = np.argsort(value, kind="stable")
                for own in np.split(at[order], np.flatnonzero(np.diff(value[order])) + 1):
                    if len(own) > 2 * BLOCK:
                        dense.append(prints[own])
                    elif len(own) > 1:
                        union.link(*(own[x] for x in block_links(prints[own])))
    return *(prints[x] for x in union.stars()), dense


def dense_links(points: DataFrame) -> DataFrame:
    """Links (a, b) of dense groups: rows (ball, print, block, blocks), each pair of blocks a group of its own."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, x, y), rows in _runs(batches, 3):
            prints, block = rows[3].view(np.uint64), rows[4]
            own, other = prints[block == x], prints[block == y]
            a, b = block_links(own) if x == y else block_links(own, other)
            every = own if x == y else np.concatenate([own, other])
            yield pa.RecordBatch.from_arrays([pa.array(every[i].view(np.int64)) for i in (a, b)], names=["a", "b"])

    each = points.select("ball", "print", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    keyed = each.select("ball", F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"), "print", "block")
    return keyed.repartition("ball", "x", "y").sortWithinPartitions("ball", "x", "y").mapInArrow(search, "a bigint, b bigint")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """Groups of rows of equal first ``keys`` columns (numbers, sorted) with their columns."""
    held, now = [], None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.any([np.diff(c) != 0 for c in columns[:keys]], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            key = tuple(int(c[i]) for c in columns[:keys])
            if held and key != now:
                yield now, [np.concatenate(x) for x in zip(*held)]
                held = []
            now = key
            held.append([c[i:j] for c in columns])
    if held:
        yield now, [np.concatenate(x) for x in zip(*held)]


def links(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in ``points`` (column print), enough to join whatever is joined."""
    spark = points.sparkSession
    n = points.count()
    # the sample: hashes below a bar that about SAMPLE points pass
    picked = points.filter(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    sample = np.array([r[0] for r in picked.select("print").collect()], np.int64).view(np.uint64)
    sample.sort()
    forests = []
    for half in (0, 1):
        size = max(24, int(len(sample) * shard / max(n, 1)))
        forests.append(build((sample >> np.uint64(32 * half)).astype(np.uint32), size))
    trees = spark.sparkContext.broadcast(forests)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for half, (tree, leaves) in enumerate(trees.value):
                at, leaf = shards_of((prints >> np.uint64(32 * half)).astype(np.uint32), tree)
                yield pa.RecordBatch.from_arrays([pa.array(leaf + half * (1 << 20)), pa.array(prints[at].view(np.int64))], names=["shard", "print"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "ball", "block", "blocks"]
        for (shard,), rows in _runs(batches, 1):
            a, b, dense = shard_links(np.unique(rows[1].view(np.uint64)), shard >> 20)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none, none], names=names)
            for k, own in enumerate(dense):
                block = np.arange(len(own)) // BLOCK
                ball = np.full(len(own), shard * (1 << 20) + k)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.nulls(len(own), pa.int64()), pa.array(ball), pa.array(block), pa.array(np.full(len(own), block[-1] + 1))], names=names)

    shards = points.select("print").mapInArrow(spread, "shard bigint, print bigint")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, 2 * sum(x[1] for x in forests)))
    found = written(shards.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(search, "a bigint, b bigint, ball bigint, block bigint, blocks bigint"))
    out, dense = found.filter("ball IS NULL").select("a", "b"), found.filter("ball IS NOT NULL")
    return out if dense.isEmpty() else out.union(dense_links(dense.select("ball", F.col("a").alias("print"), "block", "blocks")))


def _rooted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and print of each row; print, least doc_id and root print of each distinct fingerprint."""
    rows = written(fingerprints(documents))
    points = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(links(points.select("print")))
    return rows, written(points.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of each row."""
    rows, rooted = _rooted(documents)
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = written(rooted.join(names, "root").select("print", "component_id"))
    return rows.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component one row, that with the smallest doc_id.

    Of a component's rows with that same doc_id (or of all, if none has one) the one of the least fingerprint
    stays, of equal ones that with the least text. Columns are kept, whatever their names.
    """
    rows, rooted = _rooted(documents)
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "print")).alias("first")
    best = written(rooted.groupBy("root").agg(first).select(F.col("first.least").alias("kept"), F.col("first.print").alias("of")))
    times = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    named = written(best.join(times.hint("merge"), F.col("kept") == F.col("doc_id")).select("kept", "of", "n"))
    names, unnamed = documents.columns, best.filter("kept IS NULL")
    # a document in one struct, so that no column meets the names used here
    whole = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    back = lambda rows: rows.select(*(F.col("row")[c].alias(c) for c in names))
    # one plan at every size: the list of ids grows with the documents, so it is never broadcast
    single = back(whole.join(named.filter("n = 1").select("kept").hint("merge"), F.col("id") == F.col("kept")))
    if named.filter("n > 1").isEmpty() and unnamed.isEmpty():
        return single
    # rows that the id alone does not tell apart: by their fingerprints too
    repeated = named.filter("n > 1").select("kept").distinct()
    unsure = whole.join(repeated.hint("merge"), F.col("id") == F.col("kept"), "left_semi").unionByName(whole.filter("id IS NULL"))
    wanted = named.filter("n > 1").select("kept", "of").unionByName(unnamed)
    told = unsure.withColumn("print", print_of(F.col("row")["text"].cast("string"))).join(wanted.hint("merge"), (F.col("print") == F.col("of")) & F.col("id").eqNullSafe(F.col("kept")))
    least = told.groupBy("kept", "of").agg(F.min_by("row", F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))).alias("row"))
    return single.unionByName(back(least))


@F.pandas_udf(LongType())
def print_of(text: pd.Series) -> pd.Series:
    """The fingerprint of each text as a signed long."""
    return pd.Series(np.array([fingerprint((x or "").encode()) for x in text], np.uint64).view(np.int64))

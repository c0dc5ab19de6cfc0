"""Nearest neighbours by inner product: a graph by NN-descent, queries by greedy graph search.

Equal vectors are one node, with the smallest ids that hold it (as many as an answer can need), so that
a frequent vector is one node and its copies still come in order of id. One more component makes all
norms equal, which turns largest inner product into nearest neighbour while the graph is built.

Start: nodes in order of random sign codes, exact neighbours within short runs, for a few sets of codes.
Each round of NN-descent is a Spark join: to each node go its neighbours and a bounded number of
the nodes that name it, with their vectors; all pairs of these that hold a new edge are scored in numpy,
and what beats the worst neighbour of either goes back to it. Rounds end when few edges change.

A query holds a beam of the best nodes seen. In each round the best that are not yet expanded send for
their neighbours by joins, until every node of every beam is expanded. Vectors travel as eight-bit numbers
with a scale, in the descent and to the beams; the best of a beam are scored again at the end, in double
precision on the vectors given. The graph is approximate, so answers are; scores are exact.

Null and zero vectors, vectors with null or non-finite components and rows with a null id take no part. Vectors
of different lengths have no inner product: each length is a graph and a search of its own. Rows that repeat an
id and vector count once. Equal scores come in order of id. An empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.common import matrix, whole_groups, written

NEIGHBOURS, REVERSE = 28, 20
TREES, RUN, FIRST = 3, 200, 12
ROUNDS, SETTLED = 8, 0.01
SENT = 6  # best new partners of a node in one local join
BEAM, EXPANDED = 192, 64
SCORED = 72  # best of a beam that are scored exactly
CHUNK = 192  # local joins at once


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Columns id, v (array of double) of the rows that take part, each once."""
    v = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return rows


def bytes_kind(table: DataFrame, vector_column: str) -> type:
    """Vectors of single precision travel as such: half the bytes, and nothing is lost."""
    return np.float32 if table.schema[vector_column].dataType.simpleString() == "array<float>" else np.float64


def nodes_of(rows: DataFrame, held: int, kind: type = np.float64) -> DataFrame:
    """Distinct vectors: node (smallest id), vec (bytes of ``kind``), members (the ``held`` smallest ids)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            flat = own.flatten().to_numpy().astype(kind) + kind(0)  # -0.0 is 0.0
            size = flat.itemsize * (len(flat) // max(1, len(own)))
            ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(own), [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])], names=["id", "vec"])

    packed = rows.mapInArrow(pack, "id bigint, vec binary").distinct()
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = packed.withColumn("k", place).filter(F.col("k") <= held)
    return kept.groupBy("vec").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("members")).select("node", "vec", "members")


def _small(x: np.ndarray) -> pa.Array:
    """Rows as eight-bit numbers with a scale of four bytes behind."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-30).astype("<f4") / np.float32(127)
    packed = np.hstack([np.rint(x / scale[:, None]).astype(np.int8).view(np.uint8), scale.view(np.uint8).reshape(-1, 4)]) if len(x) else np.zeros((0, 4), np.uint8)
    ends = pa.array(np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, ends.buffers()[1], pa.py_buffer(packed.tobytes())])


def _points(column: pa.Array) -> np.ndarray:
    """Rows that ``_small`` packed, in single precision."""
    packed = matrix(column, np.uint8)
    return packed[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(packed[:, -4:]).view("<f4") if len(column) else np.zeros((0, 1), np.float32)


def _lists(ids: np.ndarray, values: list[np.ndarray], counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row an id, with lists of ``counts`` values each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values)], names=names)


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The ``keep`` best distinct others of each owner: owners, numbers, and other, sim, *more in order.

    Of equal pairs the first given stays.
    """
    order = np.lexsort((np.arange(len(owner)), other, owner))
    own, oth = owner[order], other[order]
    order = order[np.concatenate([[True], (own[1:] != own[:-1]) | (oth[1:] != oth[:-1])])] if len(order) else order
    order = order[np.lexsort((other[order], -sim[order], owner[order]))]
    owners, first, counts = np.unique(owner[order], return_index=True, return_counts=True)
    place = np.arange(len(order)) - np.repeat(first, counts)
    order = order[place < keep]
    return owners, np.minimum(counts, keep), [x[order] for x in (other, sim, *more)]


def _first_graph(space: DataFrame, n: int, width: int) -> DataFrame:
    """Edges (id, nbr, sim) from short runs of nodes in order of random codes."""
    bits = max(1, min(40, int(np.ceil(np.log2(max(2, n / RUN))))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column(1))
            for tree in range(TREES):
                planes = np.random.default_rng(1000 + tree).standard_normal((x.shape[1], bits + 1)).astype(np.float32)
                z = x @ planes
                key = (z[:, :bits] > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) + (np.int64(tree) << np.int64(44))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(z[:, bits]), *batch.columns], names=["code", "along", "id", "vec"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.RecordBatch) -> pa.RecordBatch:
            ids, x = table.column(0).to_numpy(), _points(table.column(1))
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            k = min(FIRST, len(ids) - 1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
            rows = np.repeat(np.arange(len(ids)), k)
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[top.ravel()]), pa.array(sims[rows, top.ravel()])], names=["id", "nbr", "sim"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * RUN:
                table = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
                yield out(table.slice(0, RUN))
                held = [table.slice(RUN)]
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0])

    coded = space.select("id", "vec").mapInArrow(code, "code bigint, along float, id bigint, vec binary")
    sorted_runs = coded.repartitionByRange("code", "along").sortWithinPartitions("code", "along").select("id", "vec")
    return sorted_runs.mapInArrow(pairs, "id bigint, nbr bigint, sim float")


GRAPH = "id bigint, vec binary, nbrs array<bigint>, sims array<float>, fresh array<boolean>"


def _merged(space: DataFrame, edges: DataFrame, keep: int) -> DataFrame:
    """The graph with ``edges`` (id, nbr, sim) merged in; what was not there before is fresh.

    ``space`` has id, vec and, if it is a graph, its lists.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            owners, counts, (other, sim) = _best(*(batch.column(i).to_numpy() for i in range(3)), keep)
            yield _lists(owners, [other, sim], counts, ["id", "cand", "csim"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            parts = []
            for a, b, fresh in ((2, 3, False), (4, 5, True)):
                lists = batch.column(a)
                counts = np.diff(lists.offsets.to_numpy()) if lists.null_count < len(lists) else np.zeros(len(lists), np.int64)
                parts.append((np.repeat(at, counts), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(b).flatten().to_numpy(zero_copy_only=False).astype(np.float32), np.full(counts.sum(), fresh)))
            owner, other, sim, fresh = (np.concatenate(x) for x in zip(*parts))
            owners, counts, (other, sim, fresh) = _best(owner, other, sim, keep, fresh)
            full = np.zeros(batch.num_rows, np.int64)
            full[owners] = counts
            lists = _lists(batch.column(0).to_numpy(), [other, sim, fresh], full, ["id", "nbrs", "sims", "fresh"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists.columns[1:]], names=["id", "vec", "nbrs", "sims", "fresh"])

    cand = edges.repartition("id").sortWithinPartitions("id").mapInArrow(top, "id bigint, cand array<bigint>, csim array<float>")
    none = lambda t: F.expr(f"CAST(array() AS array<{t}>)")
    if "nbrs" not in space.columns:
        space = space.select("id", "vec", none("bigint").alias("nbrs"), none("float").alias("sims"))
    rows = space.join(cand, "id", "left").select("id", "vec", "nbrs", "sims", F.coalesce("cand", none("bigint")).alias("cand"), F.coalesce("csim", none("float")).alias("csim"))
    return rows.mapInArrow(merge, GRAPH)


def _local_joins(graph: DataFrame, keep: int) -> DataFrame:
    """Edges (id, nbr, sim) between neighbours of a common node that improve the list of ``id``."""
    worst = F.when(F.size("sims") < keep, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float")
    points = graph.select("id", "vec", worst.alias("worst"))
    edges = graph.select("id", "vec", worst.alias("worst"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("id", "vec", "worst", F.col("e.nbrs").alias("nbr"), F.col("e.fresh").alias("fresh"))
    ahead = edges.select(F.col("id").alias("target"), "nbr", "fresh").join(points, F.col("nbr") == F.col("id")).select("target", F.col("nbr").alias("member"), "vec", "worst", "fresh")
    place = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("fresh"), F.xxhash64("id", "nbr")))
    behind = edges.withColumn("k", place).filter(F.col("k") <= REVERSE).select(F.col("nbr").alias("target"), F.col("id").alias("member"), "vec", "worst", "fresh")
    own = points.select(F.col("id").alias("target"), F.col("id").alias("member"), "vec", "worst", F.lit(False).alias("fresh"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            target, member, worst = (batch.column(i).to_numpy() for i in (0, 1, 3))
            fresh = batch.column(4).to_numpy(zero_copy_only=False)
            vec = _points(batch.column(2))
            order = np.lexsort((~fresh, member, target))
            t, m = target[order], member[order]
            order = order[np.concatenate([[True], (t[1:] != t[:-1]) | (m[1:] != m[:-1])])]
            target, member, worst, fresh, vec = target[order], member[order], worst[order], fresh[order], vec[order]
            _, first, counts = np.unique(target, return_index=True, return_counts=True)
            wide = int(counts.max())
            for i in range(0, len(first), CHUNK):
                c, f = counts[i : i + CHUNK], first[i : i + CHUNK]
                here = np.arange(wide)[None, :] < c[:, None]
                at = np.minimum(f[:, None] + np.arange(wide)[None, :], len(member) - 1)
                x, new = vec[at], fresh[at] & here
                sims = np.matmul(x, x.transpose(0, 2, 1))
                usable = (new[:, :, None] | new[:, None, :]) & here[:, :, None] & here[:, None, :] & (sims > worst[at][:, :, None])
                usable[:, np.arange(wide), np.arange(wide)] = False
                sims = np.where(usable, sims, -np.inf)
                k = min(SENT, wide)
                top = np.argpartition(-sims, k - 1, axis=2)[:, :, :k]
                best = np.take_along_axis(sims, top, axis=2)
                g, a, b = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(member[at[g, a]]), pa.array(member[at[g, top[g, a, b]]]), pa.array(best[g, a, b])], names=["id", "nbr", "sim"])

    rows = ahead.union(behind).union(own)
    return rows.repartition("target").sortWithinPartitions("target").mapInArrow(join, "id bigint, nbr bigint, sim float")


def neighbour_graph(nodes: DataFrame, keep: int = NEIGHBOURS, rounds: int = ROUNDS, kind: type = np.float64) -> DataFrame:
    """NN-descent over ``nodes`` (node, vec): the graph with lists of about the ``keep`` nearest nodes."""
    n = nodes.count()
    norm = lambda batch: (matrix(batch.column(1), kind).astype(np.float64) ** 2).sum(axis=1)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([norm(batch).max()])], names=["most"])

    most = nodes.select("node", "vec").mapInArrow(norms, "most double").agg(F.max("most")).first()[0] or 1.0

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), kind).astype(np.float64)
            more = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None] if batch.num_rows else np.zeros((0, 1))
            rows = np.hstack([x, more]).astype(np.float32) / np.float32(most**0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), _small(rows)], names=["id", "vec"])

    space = written(nodes.select("node", "vec").mapInArrow(lift, "id bigint, vec binary"))
    graph = written(_merged(space, _first_graph(space, n, keep), keep))
    for _ in range(rounds):
        graph = written(_merged(graph, _local_joins(graph, keep), keep))
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed <= SETTLED * n * keep:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, seeds: DataFrame, beam: int = BEAM, kind: type = np.float64) -> DataFrame:
    """Greedy search: columns query, node, sim (exact) with up to ``SCORED`` nodes a query.

    ``queries``: query, qvec (bytes of ``kind``, as the nodes' vec); ``seeds``: query, node to start from, one at least.
    """
    back = graph.select("id", F.explode("nbrs").alias("nbr"))
    place = F.row_number().over(Window.partitionBy("nbr").orderBy(F.xxhash64("id", "nbr")))
    reverse = back.withColumn("k", place).filter(F.col("k") <= REVERSE).groupBy("nbr").agg(F.collect_list("id").alias("rev"))
    links = written(graph.select("id", "nbrs").join(reverse, F.col("id") == F.col("nbr"), "left").select("id", F.array_distinct(F.concat("nbrs", F.coalesce("rev", F.expr("CAST(array() AS array<bigint>)")))).alias("links")))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _small(matrix(batch.column(1), kind).astype(np.float64))], names=["nbr", "vec"])

    vectors = written(nodes.select("node", "vec").mapInArrow(shrink, "nbr bigint, vec binary"))
    state_type = "query bigint, qvec binary, held array<bigint>, sims array<double>, done array<boolean>"
    none = lambda t: F.expr(f"CAST(array() AS array<{t}>)")
    state = queries.select("query", "qvec", none("bigint").alias("held"), none("double").alias("sims"), none("boolean").alias("done"))
    wanted = seeds.select("query", F.col("node").alias("nbr"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, rows=4000):
            query, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, found = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            qvec = batch.column(4).take(pa.array(rows))
            at = np.searchsorted(query[rows], query[found])
            nbr = batch.column(2).take(pa.array(found)).to_numpy()
            x = _points(pa.concat_arrays([batch.column(3).take(pa.array(found))])).astype(np.float64)
            asked = matrix(pa.concat_arrays([qvec]), kind).astype(np.float64)
            sim = np.einsum("ij,ij->i", x, asked[at]) if len(found) else np.zeros(0)
            lists = [batch.column(i).take(pa.array(rows)) for i in (5, 6, 7)]
            counts = np.diff(lists[0].offsets.to_numpy())
            own = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            owner = np.concatenate([np.repeat(np.arange(len(rows)), counts), at])
            owners, n, (held, sims, done) = _best(owner, np.concatenate([own[0], nbr]).astype(np.int64), np.concatenate([own[1], sim]).astype(np.float64), beam, np.concatenate([own[2], np.zeros(len(nbr))]).astype(bool))
            full = np.zeros(len(rows), np.int64)
            full[owners] = n
            out = _lists(query[rows], [held, sims, done], full, ["query", "held", "sims", "done"])
            yield pa.RecordBatch.from_arrays([out.column(0), qvec, *out.columns[1:]], names=["query", "qvec", "held", "sims", "done"])

    while True:
        scored = wanted.join(vectors, "nbr").select("query", F.lit(1).alias("kind"), "nbr", "vec", F.lit(None).cast("binary").alias("qvec"), none("bigint").alias("held"), none("double").alias("sims"), none("boolean").alias("done"))
        rows = state.select("query", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("nbr"), F.lit(None).cast("binary").alias("vec"), "qvec", "held", "sims", "done")
        state = written(rows.union(scored).repartition("query").sortWithinPartitions("query").mapInArrow(step, state_type))
        # the best nodes that are not expanded yet send for their neighbours
        open_ = F.slice(F.filter(F.arrays_zip("held", "done"), lambda x: ~x["done"]), 1, EXPANDED)
        front = written(state.select("query", F.explode(open_).alias("o")).select("query", F.col("o.held").alias("node")))
        if front.isEmpty():
            break
        wanted = front.join(links, F.col("node") == F.col("id")).select("query", F.explode("links").alias("nbr")).distinct()
        fronts = front.groupBy("query").agg(F.collect_list("node").alias("front"))
        expanded = F.transform(F.arrays_zip("held", "done"), lambda x: x["done"] | F.coalesce(F.array_contains("front", x["held"]), F.lit(False)))
        state = state.join(fronts, "query", "left").select("query", "qvec", "held", "sims", expanded.alias("done"))
    best = F.slice(F.col("held"), 1, SCORED)  # beams are in order

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (matrix(batch.column(i), kind).astype(np.float64) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", x, y))], names=["query", "node", "sim"])

    found = state.select("query", "qvec", F.explode(best).alias("node")).join(nodes.select("node", "vec"), "node").select("query", "node", "vec", "qvec")
    return found.mapInArrow(rescore, "query bigint, node bigint, sim double")


def nearest(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Queries are rows of the index: a search starts from the query's own node, once for equal queries.
    """
    rows = written(usable(table, id_column, vector_column))
    kind = bytes_kind(table, vector_column)
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest_of(rows.filter(F.size("v") == n) if len(lengths) > 1 else rows, kind, every, k) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest_of(rows: DataFrame, kind: type, every: int, k: int) -> DataFrame:
    """``nearest`` among ``rows`` (id, v) of one length."""
    nodes = written(nodes_of(rows, k + 1, kind))
    graph = neighbour_graph(nodes.select("node", "vec"), kind=kind)

    # the node of each query: equal vectors meet in their bytes
    asked = nodes_of_ids(rows.filter(F.col("id") % every == 0), nodes, kind)
    starts = written(asked.select("node").distinct())
    queries = starts.join(nodes.select("node", "vec"), "node").select(F.col("node").alias("query"), F.col("vec").alias("qvec"))
    found = search(queries, nodes.select("node", "vec"), graph, starts.select(F.col("node").alias("query"), "node"), kind=kind)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    short = found.withColumn("p", place).filter(F.col("p") <= 2 * k).select("query", "node", "sim")
    members = short.join(nodes.select("node", "members"), "node").select("query", "sim", F.explode("members").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id"))
    answers = written(members.withColumn("p", place).filter(F.col("p") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("p", "vec_id", "sim"))).alias("answers")))
    own = asked.join(answers, F.col("node") == F.col("query"))
    others = F.slice(F.filter("answers", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", F.col("col.sim").alias("score"))


def nodes_of_ids(rows: DataFrame, nodes: DataFrame, kind: type = np.float64) -> DataFrame:
    """id and node of each of ``rows`` (id, v): through the members listed, or else through the vector."""
    listed = nodes.select("node", F.explode("members").alias("id"))
    near = rows.select("id").distinct().join(listed, "id", "left")
    found = near.filter("node IS NOT NULL").select("id", "node")
    # ids beyond those listed: join on a hash of the vector, then compare it
    rest = rows.join(near.filter("node IS NULL").select("id"), "id", "left_semi").select("id", F.transform("v", lambda x: x + 0.0).alias("v"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), kind).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["node", "w"])

    full = nodes.filter(F.size("members") > 1).select("node", "vec").mapInArrow(unpack, "node bigint, w array<double>")
    hashed = written(full.select("node", "w", F.xxhash64("w").alias("h")))
    later = rest.withColumn("h", F.xxhash64("v")).join(hashed, "h").filter(F.col("v") == F.col("w")).select("id", "node")
    return found.union(later)

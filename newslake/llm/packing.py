"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, so that all
pieces but the first are full. The number of pieces of each length is all that the planner sees: best
fit over these counts, longest first, gives ranges "pieces of length L with ranks r.. take bins b..,
k in a bin, from offset o". The plan has no more entries than lengths and bin sizes allow, whatever
the number of documents. Pieces then take their slots by joining on rank within length. A rank is a
piece's place among those of its length in its own partition, plus how many stand in the partitions
before it, so that no task holds all pieces of a frequent length.

Only the pieces are written, and the slots come in no more partitions than the documents did (or the session
has cores), whatever the number of shuffle partitions: Hadoop's local file system starts a process for each
file and folder that a task makes, and until it runs its own program it shares, and shows, the executor's memory.

Null and empty texts give the end id alone; very long texts are encoded in segments and give many pieces. Repeated rows are packed as often as they occur; rows with
a null doc_id are packed too. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.bpe import tokenizer
from newslake.llm.common import freed, parts_of, texts_of, written

RANKS = 1 << 40  # more pieces of one length than any table has


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, first bin, items in a bin, offset of the first) of a best-fit-decreasing plan.

    Bins of equal free space are kept as ranges of bin numbers. A range that gets items of one length
    is filled bin by bin with as many as fit, which is what best fit does item by item.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    bins = 0

    def put(space: int, start: int, number: int) -> None:
        if number and space:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((start, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                space, fit = capacity, capacity // length
                start, number = bins, -(-left // fit)
                bins += number
            else:
                space = spaces[at]
                start, number = free[space].pop()
                fit = space // length
                if not free[space]:
                    del free[space], spaces[at]
            full, rest = divmod(min(left, number * fit), fit)
            plan.append((length, rank, start, fit, capacity - space))
            put(space - fit * length, start, full)
            if rest:
                put(space - rest * length, start + full, 1)
            put(space, start + full + bool(rest), number - full - bool(rest))
            rank, left = rank + full * fit + rest, left - full * fit - rest
    return plan


def document_pieces(documents: DataFrame, encode: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]], end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document with their checksum, partition and rank by length within the partition.

    ``encode()`` is called once in a worker and gives a function from texts to the ids of each.
    """
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = encode(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in parts_of(whole, whole.column(1))):
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), ids_of(texts_of(batch.column(1)))):
                ids = found.astype("<u4").tobytes() + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = capacity if piece else first
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
        freed()

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint")


def packed(documents: DataFrame, tokenizer_path: str, kind: str = "byte", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Slots of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = written(document_pieces(documents, lambda: tokenizer(kind, tokenizer_path).encode_batch, end_id, capacity))
    # at most one row for each length up to the capacity
    found = pieces.groupBy("length").agg(F.count("*").alias("n"), F.max("part").alias("part")).collect()
    plan = sorted(best_fit({r.length: r.n for r in found}, capacity))
    tasks = max([spark.sparkContext.defaultParallelism, *(r.part + 1 for r in found)])
    table = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = shares.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, bins, fits, offsets = table.value.T
        keys = lengths * RANKS + ranks
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * RANKS + rank, "right") - 1
            nth = rank - ranks[at]
            slot = [bins[at] + nth // fits[at], offsets[at] + nth % fits[at] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, slot)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.coalesce(tasks).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

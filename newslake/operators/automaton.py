"""Many patterns in one pass over each text (F11): an Aho-Corasick automaton in Arrow batches.

All occurrences are found, overlapping ones and those within others too; with ``bounded`` only where no letter,
number or underscore stands before or behind. Patterns come as a table of a column ``word``. Automata of at most ``BLOCK``
letters are built on the driver and broadcast, so what a task holds has a bound; more patterns than one holds are several
blocks, each of which passes over the texts. Patterns are met as they are: lower both sides for any case.

Null and empty texts and patterns match nothing; patterns that repeat count once; very long texts are matched whole.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8_000_000  # letters of an automaton's patterns, some 300 MB
ROWS = 50_000


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """Patterns for one pass: ``found`` gives the places of all in a text, ``prefixed`` those that begin with a text."""

    def __init__(self, words: list[str]):
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in words:
            if word:
                self.trie.add_word(word)
        self.trie.make_automaton()

    def found(self, text: str, bounded: bool = True) -> Iterator[tuple[int, int]]:
        """Start and end of every occurrence, by end, then longest first."""
        if not len(self.trie):
            return
        n = len(text)
        for last, length in self.trie.iter(text):
            start, end = last - length + 1, last + 1
            if bounded and (start and _word(text[start - 1]) and _word(text[start]) or end < n and _word(text[end]) and _word(text[last])):
                continue
            yield start, end

    def prefixed(self, prefix: str) -> list[str]:
        return sorted(self.trie.keys(prefix))


def blocks_of(patterns: DataFrame, block: int = BLOCK) -> Iterator[Automaton]:
    """Automata of about ``block`` letters each of the distinct patterns, streamed to the driver a block at a time."""
    held, size = [], 0
    for row in patterns.select("word").filter("word <> ''").distinct().toLocalIterator():
        held.append(row.word)
        size += len(row.word)
        if size >= block:
            yield Automaton(held)
            held, size = [], 0
    if held:
        yield Automaton(held)


def occurrences(rows: DataFrame, patterns: DataFrame, bounded: bool = True, block: int = BLOCK) -> DataFrame:
    """id, word, start, end (code points, end exclusive) of all patterns in ``rows`` (id, text)."""

    def each(texts: list[str | None], ids: list[int], automaton: Automaton) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for id_, text in zip(ids, texts):
            for start, end in automaton.found(text or "", bounded):
                out.append((id_, text[start:end], start, end))
                if len(out) >= ROWS:
                    yield _batch(out, ("id", "word", "start", "end"))
                    out = []
        if out:
            yield _batch(out, ("id", "word", "start", "end"))

    return _passed(rows, patterns, each, "id bigint, word string, start bigint, end bigint", block)


def tallies(rows: DataFrame, patterns: DataFrame, bounded: bool = True, block: int = BLOCK) -> DataFrame:
    """id, word, n: how often each pattern is in each of ``rows`` (id, text), where it is at all; counted in the pass."""

    def each(texts: list[str | None], ids: list[int], automaton: Automaton) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for id_, text in zip(ids, texts):
            counts = Counter(text[start:end] for start, end in automaton.found(text or "", bounded))
            out += [(id_, word, n) for word, n in counts.items()]
            if len(out) >= ROWS:
                yield _batch(out, ("id", "word", "n"))
                out = []
        if out:
            yield _batch(out, ("id", "word", "n"))

    return _passed(rows, patterns, each, "id bigint, word string, n bigint", block)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.record_batch({name: pa.array(column, pa.string() if name == "word" else pa.int64()) for name, column in zip(names, zip(*rows))})


def _passed(rows: DataFrame, patterns: DataFrame, each, schema: str, block: int) -> DataFrame:  # noqa: ANN001
    texts = rows.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))

    def one(automaton: Automaton) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(automaton))

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(shared.value)
            for batch in batches:
                yield from each(batch.column(1).to_pylist(), batch.column(0).to_pylist(), own)

        return texts.mapInArrow(compute, schema)

    parts = [one(a) for a in blocks_of(patterns, block)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)

"""Periodic runs of words: every maximal repetition of a text, found by Lyndon words under both orders.

A run is a stretch of words with smallest period q and at least ``TIMES`` times q words (and ``LEAST``) that no
neighbouring word extends. Under one of the two orders of words (by number, or the reverse; the end is smaller than any
word in both) the word behind a run is smaller than the period would have it; under that order the longest Lyndon word
that begins at a root of the run is the root itself. So a stack scanned from right to left gives for each place the
longest Lyndon word there, in each order, and each is a candidate period, extended to both sides; at most two
candidates a word, no suffix array.

Suffixes are compared, and candidates extended, by the length of their common part: a few words directly, then a
binary search on rolling hashes (sums of random word values times powers, modulo 2^64, made only for texts that need
them). What a hash calls equal is compared word by word in numpy, and a collision falls back to the first
word that differs, so results are exact. For each distance the last stretch that was compared is held, so that periodic
texts compare each word once for a distance.

A text is one row's own work: nothing is shuffled, and the largest text bounds a task's memory. Null and empty texts
have no words and no runs. A null doc_id plants nothing (``planted``). Repeated rows each return, very long texts are
taken whole, an empty table gives an empty result, extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import bytes_of

LEAST, TIMES = 6, 4  # words of a run, and times its period; TIMES is 3 or more
DIRECT = 8  # words that are compared before hashes are
MASK = (1 << 64) - 1
Run = tuple[int, int, int]  # start, length, period


class Common:
    """Lengths of common parts of a sequence of numbers with itself at a distance."""

    def __init__(self, numbers: list[int]):
        self.numbers, self.n = numbers, len(numbers)
        self.array = np.array(numbers, np.int64)
        self.held: dict[int, tuple[int, int]] = {}  # by distance: a stretch that is equal, word by word, and ends at a difference
        self.sums: list[int] | None = None

    def _equal(self, i: int, j: int, length: int) -> bool:
        """By hashes."""
        if self.sums is None:
            rng = np.random.default_rng(self.n)
            values = rng.integers(1, 1 << 63, int(self.array.max()) + 1, np.uint64)
            base = int(rng.integers(1, 1 << 62)) * 2 + 1
            powers = np.cumprod(np.array([1] + [base] * self.n, np.uint64), dtype=np.uint64)
            self.sums = [0, *np.cumsum(values[self.array] * powers[:-1], dtype=np.uint64).tolist()]
            self.powers = powers.tolist()
        s = self.sums
        return (s[i + length] - s[i]) * self.powers[j - i] & MASK == (s[j + length] - s[j]) & MASK

    def ahead(self, i: int, d: int) -> int:
        """End of the stretch from ``i`` that equals the words ``d`` further; the words at ``i`` are equal."""
        known = self.held.get(d)
        if known and known[0] <= i <= known[1]:
            return known[1]
        a, end, k = self.numbers, self.n - d, i + 1
        stop = min(end, i + DIRECT)
        while k < stop and a[k] == a[k + d]:
            k += 1
        if k < stop or k == end:
            return k
        low, high = k, end  # equal up to low
        while low < high:
            middle = (low + high + 1) // 2
            if self._equal(i, i + d, middle - i):
                low = middle
            else:
                high = middle - 1
        joins = known and i < known[0] <= low
        upto = known[0] if joins else low
        same = self.array[i:upto] == self.array[i + d : upto + d]
        if not same.all():
            low = i + int(np.argmin(same))
        elif joins:
            low = known[1]
        self.held[d] = (i, low)
        return low

    def back(self, i: int, d: int) -> int:
        """Start of the stretch before ``i`` that equals the words ``d`` further."""
        a, k = self.numbers, i
        stop = max(0, i - DIRECT)
        while k > stop and a[k - 1] == a[k - 1 + d]:
            k -= 1
        if k > stop or not k:
            return k
        low, high = 0, k
        while low < high:
            middle = (low + high) // 2
            if self._equal(middle, middle + d, i - middle):
                high = middle
            else:
                low = middle + 1
        same = self.array[low:i] == self.array[low + d : i + d]
        return low if same.all() else i - int(np.argmin(same[::-1]))


def lyndon_ends(values: list[int], ahead: Callable[[int, int], int]) -> list[int]:
    """Ends of the longest Lyndon words from each place; ``values`` has one number more, smaller than all, at its end."""
    n = len(values) - 1
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        x, j = values[i], i + 1
        while True:
            y = values[j]
            if x < y:
                j = ends[j]
            elif x > y:
                break
            else:
                y, end = values[i + 1], values[j + 1]  # most equal words are followed by others
                if y == end:
                    end = ahead(i, j - i)
                    y, end = values[end], values[end + j - i]
                if y > end:
                    break
                j = ends[j]
        ends[i] = j
    return ends


def runs_of(numbers: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a sequence of numbers from 0, by start, then period."""
    n = len(numbers)
    if n < least:
        return []
    common = Common(numbers)
    array, top = common.array, max(numbers)
    found: set[Run] = set()
    places = np.arange(n)
    for values in (numbers, [top - x for x in numbers]):
        ends = np.array(lyndon_ends([*values, -1], common.ahead))
        # a run of three periods and more has a root that is followed by another whole one
        start = places[2 * ends - places <= n]
        period = ends[start] - start
        start, period = (x[(array[start] == array[start + period]) & (array[start + period - 1] == array[start + 2 * period - 1])] for x in (start, period))
        last: dict[int, tuple[int, int]] = {}
        for i, p in zip(start.tolist(), period.tolist()):
            if p in last and last[p][0] <= i and i + p < last[p][1]:
                continue
            first, end = common.back(i, p), common.ahead(i, p) + p
            last[p] = first, end
            if end - first >= max(least, times * p):
                found.add((first, end - first, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of all documents, repeated from a place on with a period; both follow from the id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(crc32(b"%d" % doc_id), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * -(-(n - a) // p))[: n - a]


def numbered(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_dropped bigint"


def described(doc_id: int | None, words: list[bytes]) -> tuple:
    runs = runs_of(numbered(words))
    kept = collapsed(words, runs)
    best = None
    for run in runs:  # by start, then period: the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *shown, sha256(listed).hexdigest(), sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept)


def periodic(documents: DataFrame, plant: bool = False) -> DataFrame:
    """Per document: its number of runs, the one of greatest exponent, digests of all runs and of the collapsed text.

    ``plant`` first repeats words of a tenth of all documents, as ``planted`` says.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                words = text.split()  # bytes: only ASCII white space
                rows.append(described(doc_id, planted(words, doc_id) if plant else words))
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.record_batch({f.split()[0]: pa.array(c, k) for f, c, k in zip(SCHEMA.split(", "), columns, kinds)})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(compute, SCHEMA)


def without_runs(documents: DataFrame) -> DataFrame:
    """All documents with their columns; where ``text`` has runs, its words without their repeats, joined by a space.

    Texts without a run stay as they are, null included; ``n_chars`` follows if there.
    """
    names = documents.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, columns = [], list(batch.columns)
            for text in batch.column(at).to_pylist():
                words = (text or "").encode().split()
                runs = runs_of(numbered(words))
                out.append(b" ".join(collapsed(words, runs)).decode() if runs else text)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([n if new == text else len(new) for n, new, text in zip(old, out, batch.column(at).to_pylist())], columns[counted].type)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(compute, documents.schema)

"""Spelling variants by full neighbourhood generation: every deletion, replacement and insertion of a word.

Words are counted over the corpus. A word's neighbours are all strings that differ by one deleted, replaced or
inserted letter of the observed alphabet, each made once: in a stretch of equal letters only the last is deleted, and a
letter is never inserted before itself. Those that are words are its near words; no distance is computed.

The candidates, some hundreds a word, never leave their task. One edit changes one zone of a word and leaves
all letters before and behind it. For a shorter length m, zones of ``ZONE`` letters are counted from the left; a word of
m or m + 1 letters stands in one group for each zone, under the letters before and behind. Two near words meet in the group of the
zone that holds their edit, and a word makes in each group the edits of that zone alone, so every neighbour is made once
and found where it is made. The letters of a zone bound a group: at most a^ZONE + a^(ZONE + 1) words for an
alphabet of a letters, 90 by the pattern, so no frequent beginning or ending of words makes a hot task. Words of more than
ZONE * ZONES letters have ZONES longer zones, so that what is shuffled, one row a word and zone, is at most 2 * ZONES
times the vocabulary. In a task, candidates are 64-bit hashes made by numpy from hashes of a word's ends and looked up in a
table of the group's words; a hit is kept if its letters are the word's.

A form is the near word of largest count (ties: smallest in code-point order) with at least ``FORM`` times a word's count. Counts at
least double from form to form, so the largest count bounds the chain, and pointers are doubled in a known number of joins.

Null and empty texts have no words; a null doc_id is written as the empty text before the colon. Very long texts and
words are taken whole. Repeated rows count as often as they occur. An empty table has no words; extra columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.lake import forgotten, written
from newslake.llm.common import whole_groups

#: The run of letters, the share of runs that lose one, the least length and count of a word.
RUN, LOSES, LEAST_LENGTH, LEAST_COUNT = rb"[a-z\xc0-\xff]+", 97, 5, 3
FORM = 2  # times a word's count that its form has at least
ZONE, ZONES = 2, 32  # letters of a zone at least, zones of a word at most
HELD = 200_000  # words that a task counts before it hands them on
MADE = 1 << 21  # candidates at once
ROWS = 60_000  # rows of groups that are taken together
BASE = 0x9E3779B97F4A7C15  # odd, the base of the hashes


def runs_of(text: str, doc_id: int | None, found: Counter) -> None:
    """Add the runs of a text to ``found``, as Latin-1 bytes, one letter each."""
    counts = Counter(re.findall(RUN, text.encode("latin-1", "replace").lower()))  # the pattern's letters are Latin-1; bytes lower only A-Z
    start = crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for word, n in counts.items():
        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if not h % LOSES:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        found[word] += n


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: distinct words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w for w in found if len(w) >= LEAST_LENGTH]
            return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in words], pa.string()), "n": pa.array([found[w] for w in words], pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    runs_of(text.as_py(), doc_id, found)
                if len(found) >= HELD:
                    yield rows()
                    found.clear()
        yield rows()

    each = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def grouped(words: DataFrame) -> DataFrame:
    """key, m, zone, word, n: each word under every zone of the lengths m that it can share with a near word."""
    lengths = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).filter(F.col("m") >= LEAST_LENGTH)
    wide = F.greatest(F.lit(ZONE), F.ceil(F.col("m") / ZONES).cast("int"))
    zones = lengths.withColumn("wide", wide).withColumn("zone", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / F.col("wide")).cast("int"))))
    start = F.col("zone") * F.col("wide")
    behind = F.least(start + F.col("wide"), F.col("m"))  # first letter behind the zone, counted in a word of m letters
    before = F.substring("word", F.lit(1), start)
    after = F.substring("word", behind + 1 + F.length("word") - F.col("m"), F.col("m") - behind)
    return zones.select(F.xxhash64("m", "zone", before, after).alias("key"), "m", "zone", "word", "n")


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [BASE] * n, np.uint64), dtype=np.uint64)


_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def hashed(letters: np.ndarray) -> np.ndarray:
    """Sums of letter times power of the base, before each place and at the end, of words of one length (a row each)."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(letters * _powers(letters.shape[1])[:-1], axis=1, out=out[:, 1:])
    return out


class _Table:
    """Hashes of words with a table of their bits, which refuses most other hashes at once."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.shift = np.uint64(64 - max(8, int(16 * len(hashes)).bit_length()))
        self.bits = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bits[self._bit(hashes)] = True

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` and words with that hash."""
        at = np.flatnonzero(self.bits[self._bit(h)])
        found = h[at]
        first, last = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        several = last - first
        places = np.repeat(at, several)
        within = np.arange(len(places)) - np.repeat(np.cumsum(several) - several, several)
        return places, self.order[np.repeat(first, several) + within]


def neighbours(words: list[bytes], m: np.ndarray, zone: np.ndarray, alphabet: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows and their near words among ``words``: for each row the edits of its zone in words of ``m`` letters.

    A row whose word has m letters replaces and inserts, one of m + 1 letters deletes.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct: dict[int, list[bytes]] = defaultdict(list)
    for word in {*words}:
        distinct[len(word)].append(word)
    table_of: dict[int, tuple[_Table, list[bytes]]] = {}
    for length, of in distinct.items():
        letters = np.frombuffer(b"".join(of), np.uint8).reshape(len(of), length).astype(np.uint64)
        table_of[length] = _Table(hashed(letters)[:, -1]), of
    signs = np.frombuffer(alphabet, np.uint8).astype(np.uint64)

    def kept(rows: np.ndarray, made: np.ndarray, length: int, edit: str, at: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """made: candidates of each row, one or one for each sign; those that are words, letter for letter."""
        if length not in table_of:
            return
        table, of = table_of[length]
        wide = made.shape[1]
        places, hit = table.hits(made.ravel())
        good_rows, good = [], []
        for place, k in zip(places.tolist(), hit.tolist()):
            word, sign = words[row := rows[place // wide]], alphabet[place % wide : place % wide + 1]
            if of[k] == (word[:at] + word[at + 1 :] if edit == "delete" else word[:at] + sign + word[at + (edit == "replace") :]):
                good_rows.append(row)
                good.append(of[k])
        if good:
            yield np.array(good_rows), good

    groups = np.stack([m, lengths, zone])
    order = np.lexsort(groups[::-1])
    cuts = np.flatnonzero(np.any(np.diff(groups[:, order], axis=1), axis=0)) + 1
    for all_rows in np.split(order, cuts) if len(order) else []:
        short, length, z = groups[:, all_rows[0]].tolist()
        power = _powers(length + 1)
        wide = max(ZONE, -(-short // ZONES))
        start, stop = z * wide, min(z * wide + wide, short)
        last = stop == short
        step = max(1, MADE // max(len(signs), length))
        for k in range(0, len(all_rows), step):
            rows = all_rows[k : k + step]
            letters = np.frombuffer(b"".join(words[r] for r in rows), np.uint8).reshape(len(rows), length).astype(np.uint64)
            sums = hashed(letters)
            whole = sums[:, -1]
            if length > short:
                for at in range(start, stop + last):
                    behind = letters[:, at + 1] if at + 1 < length else np.full(len(rows), 256, np.uint64)
                    of = np.flatnonzero(behind != letters[:, at])  # the last of equal letters
                    made = sums[of, at] + (whole[of] - sums[of, at + 1]) * _INVERSE
                    yield from kept(rows[of], made[:, None], length - 1, "delete", at)
                continue
            for at in range(start, stop + last):
                if at < length:
                    made = whole[:, None] + (signs - letters[:, at, None]) * power[at]
                    made[signs == letters[:, at, None]] = 0  # the word itself; letters are never 0, so 0 is no word's hash but by chance
                    yield from kept(rows, made, length, "replace", at)
                made = sums[:, at, None] + signs * power[at] + (whole - sums[:, at])[:, None] * np.uint64(BASE)
                if at < length:
                    made[signs == letters[:, at, None]] = 0  # never before itself
                yield from kept(rows, made, length + 1, "insert", at)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of every pair of near words, each once. ``words``: word and n, read three times."""
    signs = words.select(F.explode(F.split("word", "")).alias("sign")).filter("sign != ''").distinct()
    alphabet = "".join(sorted(r.sign for r in signs.collect())).encode("latin-1")  # at most the pattern's 90 letters

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, rows=ROWS):
            texts = batch.column(3).to_pylist()
            words = [w.encode("latin-1") for w in texts]
            n = dict(zip(words, batch.column(4).to_pylist()))
            for rows, near in neighbours(words, batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64), alphabet):
                yield pa.record_batch({"word": pa.array([texts[r] for r in rows], pa.string()), "near": pa.array([w.decode("latin-1") for w in near], pa.string()), "near_n": pa.array([n[w] for w in near], pa.int64())})

    dealt = grouped(words).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(match, "word string, near string, near_n bigint")


def roots(links: DataFrame, largest: int) -> DataFrame:
    """word and root: the last of a chain of forms. ``links``: word and form; ``largest``: the largest count."""
    out = written(links.select("word", F.col("form").alias("root")))
    steps = max(1, largest // LEAST_COUNT).bit_length()  # forms of a chain at most, as counts double
    for _ in range(max(0, (steps - 1).bit_length())):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        forgotten(out)
        out = longer
    return out


def variants(documents: DataFrame) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(documents))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = written(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")))
    formed = words.join(near, "word", "left").withColumn("is", -F.col("best.less") >= FORM * F.col("n"))
    formed = written(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("is"), F.col("best.near")).alias("form"), F.when(F.col("is"), -F.col("best.less")).alias("form_n")))
    last = roots(formed.filter("form IS NOT NULL"), words.agg(F.max("n")).first()[0] or 0)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

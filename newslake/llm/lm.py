"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) * P(unit | class, context) * P(word | unit). Classes and
units come from the corpus: the most frequent words are units of their own, all other words share units
by their last two bytes, and units are dealt to ``CLASSES`` classes of ``UNITS``. Both softmaxes have
hashed context features: the word before, the one two before (skip), three before (skip) and the pair
of the two before; the second also hashes the class. A shared unit's words follow their counts with an
absolute discount, whose mass goes to the unknown word of that unit, so that probabilities sum to one
over known words and one unknown word a unit.

Training is one pass over all training documents in rounds of disjoint documents (``rounds_of``: more for larger
corpora, at no more work): each task starts from the broadcast weights, makes AdaGrad steps in numpy batches and
returns what it changed, by blocks of rows; Spark averages a row's changes by how often each task used it, with
many tasks in two steps. The weights, which each task broadcasts and sends back, have a fixed size; scores depend a
little on how rows are dealt to tasks, as tasks learn apart.

Counts cover all training tokens: words are 64-bit hashes, counted in numpy within a task and summed by
Spark. Scores need every token's count, so frequent words (a fixed number) are broadcast and the rest
of the tokens are joined with the counts.

Null and empty texts have the end token alone; very long texts are read in segments. A null doc_id is a training document. Repeated rows each
count and each return. Without training documents the base and the score of a token are those of one
unknown word (0). Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import bytes_of, mix64, written
from newslake.llm.tokens import batches

CLASSES, UNITS = 16, 16
ALONE = 160  # words with a unit of their own
SLOTS = 1 << 18  # of the table of frequent words
ROWS = (1 << 15, 1 << 16)  # of the weights of classes and of units, whose numbers have 16 bits
BLOCK = 256  # rows of weights that travel together
ROUNDS, ROUND_TOKENS = 2, 1 << 29  # rounds, and the tokens from which fourfold ones have one more
GROUPED = 64  # parts that changes of more than four times as many tasks are merged in first
STEP = 4096  # tokens of a gradient step
RATE = 0.15
DISCOUNT = 0.6
END = np.uint64(0x5851F42D4C957F2D)  # hash of the end token
SUFFIXES = 1 << 16
N_FEATURES = 4


def _with_ends(hashes: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts, each with its end; suffixes; the text of each token."""
    at = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    return np.insert(hashes, at, END), np.insert(suffix, at, 0), doc


def word_counts(documents: DataFrame) -> DataFrame:
    """Columns word (hash), suffix, n over all rows."""

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            words, at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.concatenate([p[1] for p in parts])[at].astype(np.int32)), pa.array(n)], names=["word", "suffix", "n"])

        held, size = [], 0
        for batch in arrow:
            for _, _, hashes, suffix, counts in batches(bytes_of(batch.column(0))):
                tokens, ends, _ = _with_ends(hashes, suffix, counts)
                words, at, n = np.unique(tokens, return_index=True, return_counts=True)
                held.append((words, ends[at], n))
                size += len(words)
                if size > 2_000_000:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    found = documents.select(F.col("text").cast("string")).mapInArrow(count, "word bigint, suffix int, n bigint")
    return found.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


class Vocabulary:
    """Totals, units of words, and the table of frequent words; its size does not depend on the corpus."""

    def __init__(self, tokens: int, distinct: int, top: list[tuple[int, int, int]], shares: list[tuple[int, int, int]]):
        """``top``: (word, suffix, n) by falling n; ``shares``: (suffix, tokens, words) over all words."""
        self.tokens, self.distinct = tokens, distinct
        words = np.array([t[0] for t in top], np.int64).view(np.uint64)
        suffix, n = (np.array([t[i] for t in top], np.int64) for i in (1, 2))
        alone = min(ALONE, len(words))
        mass, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for s, k, d in shares:
            mass[s], kinds[s] = k, d
        np.subtract.at(mass, suffix[:alone], n[:alone])
        np.subtract.at(kinds, suffix[:alone], 1)
        n_units = CLASSES * UNITS
        shared = n_units - ALONE
        order = np.argsort(-mass, kind="stable")
        own = np.empty(SUFFIXES, np.int64)  # unit of a suffix, before units are dealt to classes
        own[order] = ALONE + np.minimum(np.arange(SUFFIXES), shared - 8)
        rest = order[shared - 8 :]
        own[rest] = ALONE + shared - 8 + rest % 8
        size = np.concatenate([n[:alone], np.zeros(ALONE - alone), np.bincount(own - ALONE, mass, shared)])
        # dealt to classes by falling size, like with like
        self.place = np.empty(n_units, np.int64)
        self.place[np.argsort(-size, kind="stable")] = np.arange(n_units)
        self.of_suffix = self.place[own]
        units = np.zeros(n_units)
        units[self.place] = size
        self.size = units
        self.kinds = np.zeros(n_units)
        np.add.at(self.kinds, self.of_suffix, kinds)
        self.shared = np.zeros(n_units, bool)
        self.shared[self.place[ALONE:]] = True
        # frequent words: one slot each, the more frequent wins; the others are looked up by a join
        slot = (words >> np.uint64(64 - 18)).astype(np.int64)
        first = np.unique(slot, return_index=True)[1]
        self.word, self.n, self.unit = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int16)
        self.word[slot[first]], self.n[slot[first]] = words[first], n[first]
        self.unit[slot[first]] = np.where(first < alone, self.place[np.minimum(first, ALONE - 1)], self.of_suffix[suffix[first]])

    def lookup(self, tokens: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token and its count, -1 where only the join can tell."""
        slot = (tokens >> np.uint64(64 - 18)).astype(np.int64)
        known = (self.word[slot] == tokens) & (self.n[slot] > 0)
        return np.where(known, self.unit[slot], self.of_suffix[suffix]).astype(np.int64), np.where(known, self.n[slot], -1)

    def within(self, unit: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | unit) for words with counts ``n`` (0: unknown)."""
        discount = np.where(self.shared[unit], DISCOUNT, 0)
        # a unit without a known word has its whole mass on the unknown one
        size = np.maximum(self.size[unit], 1e-9)
        seen = (n - discount) / size
        unseen = np.where(self.kinds[unit] > 0, discount * self.kinds[unit] / size, 1)
        return np.log10(np.clip(np.where(n > 0, seen, unseen), 1e-300, 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    # frequent words by a bar on their count, found from a histogram of sixteenths of powers of two
    bin_ = F.floor(F.log2("n") * 16)
    bar, held = None, 0
    for b, k in sorted(((r[0], r[1]) for r in counts.groupBy(bin_.alias("b")).count().collect()), reverse=True):
        if held + k > SLOTS // 2:
            break
        bar, held = b, held + k
    top = [] if bar is None else [tuple(r) for r in counts.filter(bin_ >= bar).select("word", "suffix", "n").collect()]
    top.sort(key=lambda t: (-t[2], t[0]))
    shares = [tuple(r) for r in counts.groupBy("suffix").agg(F.sum("n"), F.count("*")).collect()]  # at most 65,536 rows
    return Vocabulary(int(total[0] or 0), int(total[1] or 0), top, shares)


def contexts(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Feature hashes of each token's context, 0 before the start of its text."""
    back = []
    for k in (1, 2, 3):
        own = np.zeros(len(tokens), np.uint64)
        own[k:] = np.where(doc[k:] == doc[:-k], tokens[:-k], 0)
        back.append(own)
    one, two, three = back
    salt = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    raw = [one + salt[0], two * np.uint64(3) + salt[1], three * np.uint64(5) + salt[2], one * np.uint64(7) ^ (two * salt[1] + salt[3])]
    return np.stack([mix64(x) for x in raw], axis=1)


class MaxEnt:
    """Weights of both softmaxes; ``bias`` starts at the units' log shares."""

    def __init__(self, vocabulary: Vocabulary | None = None, state: tuple | None = None):
        if state:
            self.bias, self.weights = state
            return
        size = vocabulary.size.reshape(CLASSES, UNITS) + vocabulary.kinds.reshape(CLASSES, UNITS) * 0.01 + 0.5
        self.bias = (np.log(size.sum(axis=1)).astype(np.float32), np.log(size).astype(np.float32))
        self.weights = [np.zeros((ROWS[0], CLASSES), np.float32), np.zeros((ROWS[1], UNITS), np.float32)]

    def rows(self, features: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
        """Rows of the weights that each token's features take."""
        first = (features >> np.uint64(49)).astype(np.int64) & (ROWS[0] - 1)
        spread = group.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        second = ((features + spread) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64) & (ROWS[1] - 1)
        return [first, second]

    def shares(self, rows: list[np.ndarray], group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For classes, and units within the token's class: scores less their maximum, their exponentials, and the sums of these.

        ``np.take`` copies whole rows, which fancy indexing takes four times as long for.
        """
        out = []
        for level in (0, 1):
            weights = self.weights[level]
            z = np.take(weights, rows[level][:, 0], axis=0)
            for k in range(1, N_FEATURES):
                z += np.take(weights, rows[level][:, k], axis=0)
            z += self.bias[0][None, :] if level == 0 else np.take(self.bias[1], group, axis=0)
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            out.append((z, e, e @ np.ones(e.shape[1], np.float32)))
        return out

    def forward(self, rows: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
        """Log probabilities of classes, and of units within the token's class."""
        return [z - np.log(total)[:, None] for z, _, total in self.shares(rows, group)]

    def learn(self, features: np.ndarray, unit: np.ndarray, square: list[np.ndarray], uses: list[np.ndarray]) -> None:
        """One AdaGrad step on tokens; ``square`` (sums of squared slopes) and ``uses`` of the rows follow."""
        group, inner = unit // UNITS, unit % UNITS
        rows = self.rows(features, group)
        for level, ((_, e, total), hit) in enumerate(zip(self.shares(rows, group), (group, inner))):
            slope = e
            slope *= (-1 / total)[:, None]
            slope[np.arange(len(unit)), hit] += 1
            flat = rows[level].ravel().astype(np.uint16)  # 16 bits are sorted by their digits
            order = np.argsort(flat, kind="stable")
            kept = flat[order]
            edge = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]]))
            own, n = kept[edge].astype(np.int64), np.diff(np.append(edge, len(kept)))
            sums = np.add.reduceat(np.take(slope, order // N_FEATURES, axis=0), edge, axis=0)
            spread = np.take(square[level], own, axis=0)
            spread += sums * sums
            square[level][own] = spread
            sums *= np.float32(RATE)
            sums /= np.sqrt(spread)
            sums += np.take(self.weights[level], own, axis=0)
            self.weights[level][own] = sums
            uses[level][own] += n

    def score(self, features: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 P(class) + log10 P(unit | class) of each token."""
        group, inner = unit // UNITS, unit % UNITS
        at = np.arange(len(unit))
        logs = [z[at, hit] - np.log(total) for (z, _, total), hit in zip(self.shares(self.rows(features, group), group), (group, inner))]
        return (logs[0] + logs[1]).astype(np.float64) / np.log(10)


def _train(documents: DataFrame, vocabulary, start: tuple) -> DataFrame:  # noqa: ANN001
    """What each task changed: level, block, change (float16 rows), uses (float32 a row)."""

    def train(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        bias, old = start.value
        model = MaxEnt(state=(bias, [w.copy() for w in old]))
        square = [np.full(w.shape, 1e-2, np.float32) for w in old]
        uses = [np.zeros(len(w), np.float32) for w in old]

        for batch in arrow:
            for _, _, hashes, suffix, counts in batches(bytes_of(batch.column(0))):
                tokens, ends, doc = _with_ends(hashes, suffix, counts)
                unit, _ = voc.lookup(tokens, ends)
                features = contexts(tokens, doc)
                for i in range(0, len(tokens), STEP):
                    model.learn(features[i : i + STEP], unit[i : i + STEP], square, uses)
        for level in (0, 1):
            change = (model.weights[level] - old[level]).astype(np.float16)
            blocks = [(b, change[b : b + BLOCK].tobytes(), uses[level][b : b + BLOCK].tobytes()) for b in range(0, len(change), BLOCK) if uses[level][b : b + BLOCK].any()]
            if blocks:
                at, changes, used = zip(*blocks)
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([TaskContext.get().partitionId() % GROUPED] * len(at), pa.int32()), pa.array(changes, pa.binary()), pa.array(used, pa.binary())], names=["level", "block", "part", "change", "uses"])

    return documents.select(F.col("text").cast("string")).mapInArrow(train, "level int, block int, part int, change binary, uses binary")


def _averaged(changes: DataFrame) -> DataFrame:
    """One row a block: the mean change of each row by its uses."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = uses = None
        for batch in batches:
            for change, used in zip(batch.column("change").to_pylist(), batch.column("uses").to_pylist()):
                n = np.frombuffer(used, np.float32).astype(np.float64)
                x = np.frombuffer(change, np.float16).reshape(len(n), -1) * n[:, None]
                total, uses = (x, n) if total is None else (total + x, uses + n)
        mean = total / np.maximum(uses, 1)[:, None]
        names = ["level", "block", "part"][: len(key)]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([mean.astype(np.float16).tobytes()], pa.binary()), pa.array([uses.astype(np.float32).tobytes()], pa.binary())], names=[*names, "change", "uses"])

    if changes.rdd.getNumPartitions() > 4 * GROUPED:
        changes = changes.groupBy("level", "block", "part").applyInArrow(merge, "level int, block int, part int, change binary, uses binary")
    return changes.groupBy("level", "block").applyInArrow(merge, "level int, block int, change binary, uses binary")


def rounds_of(tokens: int) -> int:
    return ROUNDS + max(0, math.ceil(math.log(max(1, tokens) / ROUND_TOKENS, 4)))


def trained(documents: DataFrame, voc: Vocabulary, rounds: int | None = None) -> MaxEnt:
    """A model from one pass over ``documents`` in rounds of disjoint rows."""
    rounds = rounds or rounds_of(voc.tokens)
    context = documents.sparkSession.sparkContext
    model, shared = MaxEnt(voc), context.broadcast(voc)
    for k in range(rounds):
        part = documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        start = context.broadcast((model.bias, model.weights))
        # at most one row for each block of the weights
        for level, block, mean, _ in _averaged(_train(part, shared, start)).collect():
            weights = model.weights[level]
            weights[block : block + BLOCK] += np.frombuffer(bytes(mean), np.float16).astype(np.float32).reshape(-1, weights.shape[1])
        start.unpersist()
    return model


def _scored(documents: DataFrame, voc: Vocabulary, model: MaxEnt) -> DataFrame:
    """Per row: row, doc_id, held_out, n_tokens, sums over frequent tokens, and the other tokens' words and units with numbers."""
    context = documents.sparkSession.sparkContext
    shared, weights = context.broadcast(voc), context.broadcast((model.bias, model.weights))
    rest_type = pa.list_(pa.struct([("word", pa.int64()), ("unit", pa.int32()), ("n", pa.int32())]))

    def score(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, own = shared.value, MaxEnt(state=weights.value)
        for batch in arrow:
            texts = bytes_of(batch.column(3))
            columns: list[list] = [[], [], [], [], [], [], [], []]
            for _, _, hashes, suffix, counts in batches(texts):
                tokens, ends, doc = _with_ends(hashes, suffix, counts)
                unit, n = voc.lookup(tokens, ends)
                features = contexts(tokens, doc)
                logs = np.concatenate([own.score(features[i : i + STEP], unit[i : i + STEP]) for i in range(0, len(tokens), STEP)])
                known = n > 0
                # a unit of one word alone has nothing left to tell
                alone = known & ~voc.shared[unit]
                logs += np.where(known & ~alone, voc.within(unit, n), 0)
                d = len(counts)
                columns[0].append(counts + 1)
                columns[1].append(np.bincount(doc, known, d).astype(np.int64))
                columns[2].append(np.bincount(doc, np.where(known, np.log10(n + 1.0), 0), d))
                columns[3].append(np.bincount(doc, logs, d))
                out = np.flatnonzero(~known)
                order = np.lexsort((tokens[out], doc[out]))
                out = out[order]
                new = np.concatenate([[True], (tokens[out][1:] != tokens[out][:-1]) | (doc[out][1:] != doc[out][:-1])]) if len(out) else np.zeros(0, bool)
                edge = np.flatnonzero(new)
                columns[4].append(np.bincount(doc[out][edge], minlength=d))
                columns[5].append(tokens[out][edge].view(np.int64))
                columns[6].append(unit[out][edge].astype(np.int32))
                columns[7].append(np.diff(np.append(edge, len(out))).astype(np.int32))
            c = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns]
            offsets = pa.array(np.concatenate([[0], np.cumsum(c[4])]).astype(np.int32))
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c[5], pa.int64()), pa.array(c[6], pa.int32()), pa.array(c[7], pa.int32())], ["word", "unit", "n"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(c[0].astype(np.int64)), pa.array(c[1].astype(np.int64)), pa.array(c[2].astype(float)), pa.array(c[3].astype(float)), rest.cast(rest_type)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "logs", "rest"])

    held = held_out().alias("held_out")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), held, F.col("text").cast("string"))
    return rows.mapInArrow(score, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, logs double, rest array<struct<word:bigint,unit:int,n:int>>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    training = documents.filter(~held_out()).select("doc_id", "text")
    counts = written(word_counts(training))
    voc = vocabulary(counts)
    model = trained(training, voc)
    rows = written(_scored(documents, voc, model))
    # tokens that the table of frequent words does not hold: their counts by a join, summed by row
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.unit", F.col("r.n").alias("times"))
    joined = rest.join(counts.select("word", "n"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    numbers = lambda x: F.array(*(F.lit(float(v)) for v in x))
    at = F.col("unit") + 1
    size, unseen = F.element_at(numbers(np.maximum(voc.size, 1e-9)), at), F.element_at(numbers(10 ** voc.within(np.arange(len(voc.size)), np.zeros(len(voc.size)))), at)
    within = F.log10(F.when(n > 0, F.least((n - DISCOUNT) / size, F.lit(1.0))).otherwise(unseen))
    sums = joined.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(n + 1.0)).alias("counted"), F.sum(F.col("times") * within).alias("inner"))
    out = rows.drop("rest").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("log_counts") + zero("counted") - F.col("n_tokens") * F.lit(float(np.log10(voc.tokens + voc.distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).cast("bigint").alias("n_known"), F.lit(voc.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("logs") + zero("inner")).alias("score"))

"""Mixing sources to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of labelled rows, gives each document's posteriors over
domains; a document's tokens count towards every domain by its posterior. Rates r >= 0, one a document,
are fitted by projected gradient so that the expected tokens of each domain, sum of r * tokens * posterior,
meet the targets in least squares, with a small ridge that keeps rates near one:

    least of  |totals(r) - target|^2 / 2 + RIDGE * all tokens * sum of tokens * (r - 1)^2 / 2,  r >= 0

Without the ridge the best rates are not unique, and those that meet a target of zero put all weight on the
few documents with the smallest posterior. Each pass is one distributed sum: every task moves the rates of its rows
against their slope, a full step of the curvature, sets what falls below zero to zero, goes on a little in the direction
of the last move (Nesterov's acceleration, begun anew where it leads uphill), and adds up the totals at the new rates.
Only these, a number for each domain, pass through the driver. A slope is scaled by its row's tokens, so rates depend on
posteriors alone and any task can repeat the moves; every ``KEPT`` moves the rates are written. Passes end when a full
step of the ridge would change no rate by more than ``TOLERANCE`` over the ridge; if they never do, it raises. Smaller
ridges take more passes: about 300 at the default and 500 at a tenth of it. A target that cannot be met is told
by ``Fit``: what each domain reaches and whether that is within ``MET`` of the target (of what there was, for a target of 0).

A rate becomes whole copies: its whole part, and one more where a hash of the document's id and text falls below the
rest, which any run repeats.

Null and empty texts have no words: they get the prior posteriors and 0 tokens, and keep a rate. Texts of any
length count whole, very long ones in segments. Labels may repeat or miss; rows with a null label are not used.
Without usable labels all documents are of one domain. Repeated rows and ties get equal rates. Empty tables give
empty results; other columns are kept whole by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.llm.common import bytes_of, forgotten, groups_of, written
from newslake.llm.tokens import BATCH_BYTES, segments, words

DIM = 1 << 16
SAMPLE = 6_000  # labelled documents, about: those with the smallest hashes of their id; texts of any length
EPOCHS = 40
RIDGE = 1e-3
PASSES, TOLERANCE = 3000, 1e-7  # far more passes than a fit takes; the error allowed in the conditions, of all tokens
KEPT = 24  # moves between two tables of rates
ROWS = 1 << 19  # rows of rates a task, about: some megabytes, which take less time than a task's start
MET = 0.01  # a target is met if the total is as close, of the target; one of 0, of the tokens that the domain had
#: The domains of the labelled table and their target weights: shares of all tokens that there are.
DOMAINS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "clean")


def _features(hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Buckets of words, and of their last two bytes as a shape."""
    half = DIM // 2
    return np.concatenate([(hashes >> np.uint64(49)).astype(np.int64) % half, half + suffix.astype(np.int64) % half])


def _bags(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts with their hashed bags: start, end, text, feature, weight, numbers of words.

    Weights have length one in each text.
    """
    for i, j in groups_of([len(x) for x in texts], BATCH_BYTES):
        if j == i + 1:  # by segments: no more is held than one of them and a count of each feature
            n, own, count = 0, np.zeros(DIM, np.int64), 0
            for part in segments(texts[i]):
                hashes, suffix, counts = words([part])
                own += np.bincount(_features(hashes, suffix), minlength=DIM)
                count += int(counts[0])
            feature = np.flatnonzero(own)
            rows, n, counts = np.zeros(len(feature), np.int64), own[feature], np.array([count])
        else:
            hashes, suffix, counts = words(texts[i:j])
            doc = np.repeat(np.arange(j - i), counts)
            code, n = np.unique(np.concatenate([doc, doc]) * DIM + _features(hashes, suffix), return_counts=True)
            rows, feature = code // DIM, code % DIM
        weight = 1 + np.log(n)
        size = np.sqrt(np.bincount(rows, weight**2, j - i))
        yield i, j, rows, feature, weight / np.maximum(size[rows], 1e-12), counts


class Classifier:
    """Softmax over hashed words."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    @classmethod
    def of_texts(cls, texts: list[bytes], labels: list[str], domains: list[str]) -> Classifier:
        bags = list(_bags(texts))
        row, feature, value = (np.concatenate([b[k] + (b[0] if k == 2 else 0) for b in bags] or [np.zeros(0, np.int64)]) for k in (2, 3, 4))
        return cls.fit(row, feature, value, labels, domains)

    @classmethod
    def fit(cls, row: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: list[str], domains: list[str]) -> Classifier:
        """Weights by full-batch AdaGrad on the log likelihood, with each domain's rows weighing alike."""
        k, n = len(domains), len(labels)
        y = np.array([domains.index(x) for x in labels], np.int64)
        prior = np.bincount(y, minlength=k) + 1.0
        weights, bias = np.zeros((DIM, k)), np.log(prior / prior.sum())
        if not len(row):
            return cls(domains, weights, bias)
        used, at = np.unique(feature, return_inverse=True)
        w, square, balance = np.zeros((len(used), k)), np.full((len(used), k), 1e-4), np.minimum((n / (k * prior))[y], 10.0)
        for _ in range(EPOCHS):
            z = bias + np.stack([np.bincount(row, value * w[at, c], n) for c in range(k)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = -p
            slope[np.arange(n), y] += 1
            slope *= balance[:, None]
            g = np.stack([np.bincount(at, value * slope[row, c], len(used)) for c in range(k)], axis=1) - 1e-3 * w
            square += g * g
            w += 1.5 * g / np.sqrt(square)
        weights[used] = w
        return cls(domains, weights.astype(np.float32), bias)

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each domain and number of words of each text."""
        k = len(self.domains)
        out, n_words = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for i, j, row, feature, value, counts in _bags(texts):
            z = self.bias + np.stack([np.bincount(row, value * self.weights[feature, c], j - i) for c in range(k)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[i:j], n_words[i:j] = p / p.sum(axis=1, keepdims=True), counts
        return out, n_words


def classifier(documents: DataFrame, labels: DataFrame, domains: dict[str, float]) -> Classifier:
    """Fitted on about ``SAMPLE`` documents with one label."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    one = named.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.countDistinct("domain").alias("n")).filter("n = 1")
    # the sample: ids whose hash is below a bar that about SAMPLE of them pass
    known = written(documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(one, "doc_id").select("doc_id", "domain"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    ids = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    first = texts.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))

    def bag(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            features, values = [np.zeros(0, np.int32)] * batch.num_rows, [np.zeros(0, np.float32)] * batch.num_rows
            for i, j, row, feature, value, _ in _bags(bytes_of(batch.column(2))):
                for k in range(i, j):
                    a, b = np.searchsorted(row, [k - i, k - i + 1])
                    features[k], values[k] = feature[a:b].astype(np.int32), value[a:b].astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (features, values))], names=["doc_id", "domain", "features", "weights"])

    # not texts but their bags: at most DIM numbers for each of about SAMPLE rows
    bags = written(first.mapInArrow(bag, "doc_id bigint, domain string, features binary, weights binary"))
    labels_, rows, features, values = [], [], [], []
    for r in bags.orderBy("doc_id").toLocalIterator():
        features.append(np.frombuffer(r.features, np.int32).astype(np.int64))
        values.append(np.frombuffer(r.weights, np.float32).astype(float))
        rows.append(np.full(len(features[-1]), len(labels_)))
        labels_.append(r.domain)
    found = [d for d in domains if d in labels_] or [next(iter(domains))]
    return Classifier.fit(*(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows, features, values)), labels_, found)


def posteriors(documents: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens, the array of posteriors and a hash of id and text of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compute(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            p, n = shared.value.posteriors(bytes_of(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists, batch.column(2)], names=["doc_id", "n_tokens", "posterior", "hash"])

    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.select("doc_id", "text", hash_of(F.col("doc_id"), F.col("text"))).mapInArrow(compute, "doc_id bigint, n_tokens bigint, posterior array<double>, hash bigint")


@dataclass(frozen=True)
class Moves:
    """Projected gradient moves of rates: the error of the totals and the share of momentum of each."""

    weight: float
    curve: float
    steps: tuple[tuple[np.ndarray, float], ...] = ()

    def walk(self, p: np.ndarray, x: np.ndarray, y: np.ndarray, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Rates ``x`` and the points ahead ``y`` after the moves from number ``after`` on.

        Then of the last move: how far it goes against the one before, and the largest change of a rate that a full step
        of the ridge would make at the point that it left.
        """
        against, far = np.zeros(len(y)), np.inf
        for k in range(after, len(self.steps)):
            error, momentum = self.steps[k]
            slope = p @ error + self.weight * (y - 1)
            new = np.maximum(0, y - slope / self.curve)
            if k == len(self.steps) - 1:
                against = (y - new) * (new - x)
                far = float(np.abs(y - np.maximum(0, y - slope / self.weight)).max(initial=0))
            x, y = new, np.maximum(0, new + momentum * (new - x))
        return x, y, against, far

    def rates(self, p: np.ndarray) -> np.ndarray:
        one = np.ones(len(p))
        return self.walk(p, one, one)[1]


@dataclass(frozen=True)
class Fit:
    """A fit by domain: the moves, targets, totals before and totals reached; and the error left in the optimum's conditions."""

    domains: list[str]
    moves: Moves
    target: np.ndarray
    before: np.ndarray
    reached: np.ndarray
    residual: float
    passes: int

    def met(self) -> np.ndarray:
        """Which targets are met; the optimum misses those that no rates near one can meet."""
        return np.abs(self.reached - self.target) <= MET * np.where(self.target > 0, self.target, self.before)

    def rows(self, spark: SparkSession) -> DataFrame:
        """domain, target, before, reached, met."""
        found = zip(self.domains, *(map(float, x) for x in (self.target, self.before, self.reached)), map(bool, self.met()))
        return spark.createDataFrame(list(found), "domain string, target double, before double, reached double, met boolean")


def _moved(batch: pa.RecordBatch, k: int, moves: Moves, after: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Tokens, posteriors and the walk of a batch of (n_tokens, posterior, x, y)."""
    tokens, x, y = (batch.column(i).to_numpy().astype(float) for i in (0, 2, 3))
    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
    return tokens, p, moves.walk(p, x, y, after)


def solve(found: DataFrame, domains: list[str], shares: list[float], ridge: float = RIDGE) -> Fit:
    """The least-squares rates for targets that are ``shares`` of all tokens of ``found`` (n_tokens, posterior)."""
    k = len(shares)
    context = found.sparkSession.sparkContext
    p = [F.col("posterior")[i] for i in range(k)]
    first = found.agg(*(F.sum(F.col("n_tokens") * a).alias(f"t{i}") for i, a in enumerate(p)), *(F.sum(F.col("n_tokens") * a * b).alias(f"c{i}_{j}") for i, a in enumerate(p) for j, b in enumerate(p)), F.count(F.lit(1)).alias("n")).first()
    first, tasks = np.array([x or 0.0 for x in first[:-1]]), -(-first[-1] // ROWS) or 1
    before, curvature = first[:k], first[k:].reshape(k, k)
    all_tokens = max(float(before.sum()), 1.0)
    target, weight = np.array(shares) * before.sum(), ridge * all_tokens
    moves = Moves(weight, weight + float(np.linalg.eigvalsh(curvature)[-1]))
    state, after = written(found.select("n_tokens", "posterior", F.lit(1.0).alias("x"), F.lit(1.0).alias("y")).coalesce(tasks)), 0

    def sums(moves: Moves, after: int) -> tuple[np.ndarray, float, float]:
        """Totals by domain at the points ahead; and of the last move, its product with the one before and its residual."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, against, worst = np.zeros(k), 0.0, 0.0
            for batch in batches:
                t, p, (_, y, back, far) = _moved(batch, k, shared.value, after)
                total += (t * y) @ p
                against += float(t @ back)
                worst = max(worst, far)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*total, against, worst)], names=names)

        shared = context.broadcast(moves)
        names = [*(f"t{i}" for i in range(k)), "against", "worst"]
        row = state.coalesce(tasks).mapInArrow(add, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c) for c in names[:-1]), F.max("worst")).first()
        shared.unpersist()
        out = [x or 0.0 for x in row]
        return np.array(out[:k]), out[k], out[-1]

    def keep(moves: Moves, after: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, _, _ = _moved(batch, k, shared.value, after)[2]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x), pa.array(y)], schema=batch.schema)

        shared = context.broadcast(moves)
        return written(state.coalesce(tasks).mapInArrow(run, state.schema))

    got, run, uphill = before, 0, False
    for passes in range(1, PASSES + 1):
        run = 0 if uphill else run + 1
        ahead = Moves(weight, moves.curve, (*moves.steps, (got - target, run / (run + 3) if run else 0.0)))
        totals, against, far = sums(ahead, after)
        residual = ridge * far
        if residual <= TOLERANCE:  # where the last move began
            forgotten(state)
            return Fit(domains, moves, target, before, got, residual, passes)
        moves, got, uphill = ahead, totals, against > 0
        if len(moves.steps) - after == KEPT:
            last, state = state, keep(moves, after)
            after = len(moves.steps)
            forgotten(last)
    raise ArithmeticError(f"rates did not settle: {residual} of all tokens left after {PASSES} passes")


def rated(documents: DataFrame, labels: DataFrame, domains: dict[str, float] = DOMAINS, ridge: float = RIDGE) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, rate and copies of each row of ``documents``.

    Then, the same in each row: target and reached tokens of each domain and whether all targets are met.
    """
    model = classifier(documents, labels, domains)
    found = written(posteriors(documents, model))
    fit = solve(found, model.domains, [domains[d] for d in model.domains], ridge)
    at = {d: i for i, d in enumerate(model.domains)}
    share = [F.col("posterior")[at[d]].alias(f"p_{d}") if d in at else F.lit(0.0).alias(f"p_{d}") for d in domains]
    told = [F.lit(float(x[at[d]]) if d in at else 0.0).alias(f"{name}_{d}") for name, x in (("target", fit.target), ("reached", fit.reached)) for d in domains]
    out = found.withColumn("rate", _rate(F.col("posterior"), fit))
    return out.select("doc_id", "n_tokens", *share, "rate", copies_of(F.col("hash"), F.col("rate")).alias("copies"), *told, F.lit(bool(fit.met().all())).alias("met"))


def _rate(posterior: Column, fit: Fit) -> Column:
    moves, k = fit.moves, len(fit.domains)

    @F.pandas_udf("double")
    def rate(values):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(moves.rates(np.concatenate([np.zeros(0), *values]).reshape(-1, k)))

    return rate(posterior)


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("copies")).alias("hash")


def copies_of(hashed: Column, rate: Column) -> Column:
    part = F.pmod(hashed, F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(documents: DataFrame, labels: DataFrame, domains: dict[str, float] = DOMAINS, ridge: float = RIDGE) -> DataFrame:
    """Each document as often as its copies say; columns are kept."""
    model = classifier(documents, labels, domains)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n_tokens:bigint,posterior:array<double>>")
    def told(text):  # noqa: ANN001, ANN202
        import pandas as pd

        p, n = shared.value.posteriors([(x or "").encode() for x in text])
        return pd.DataFrame({"n_tokens": n, "posterior": list(p)})

    names = documents.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    # the documents with their posteriors: computed once, read for the sums of every pass and for the copies
    found = written(documents.select(row, told(F.col("text").cast("string")).alias("told")))
    fit = solve(found.select("told.n_tokens", "told.posterior"), model.domains, [domains[d] for d in model.domains], ridge)
    hashed = hash_of(F.col("row.doc_id").cast("bigint"), F.col("row.text").cast("string"))
    rate = found.select("row", hashed, _rate(F.col("told.posterior"), fit).alias("rate"))
    copied = rate.select("row", copies_of(F.col("hash"), F.col("rate")).alias("copies"))
    each = copied.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*(F.col("row")[c].alias(c) for c in names))

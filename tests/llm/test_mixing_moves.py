"""Mixing: moves walked again from any point, copies by their arithmetic, targets met or not."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newslake.llm import mixing


def test_moves_walked_in_parts():
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 1, 1], 200)
    steps = tuple((rng.standard_normal(3) * 50, k / (k + 3)) for k in range(30))
    moves, one = mixing.Moves(10.0, 400.0, steps), np.ones(200)
    x, y, _, _ = mixing.Moves(10.0, 400.0, steps[:24]).walk(p, one, one)
    assert np.array_equal(moves.walk(p, x, y, 24)[1], moves.rates(p)) and (moves.rates(p) >= 0).all()
    # a plain loop over one row
    x = y = 1.0
    for error, momentum in steps:
        new = max(0.0, y - (p[7] @ error + 10.0 * (y - 1)) / 400.0)
        x, y = new, max(0.0, new + momentum * (new - x))
    assert moves.rates(p)[7] == pytest.approx(y)


@pytest.mark.parametrize("kept", [2, 1000])
def test_rates_do_not_depend_on_written_tables(spark, monkeypatch, kept):
    rng = np.random.default_rng(9)
    p, t = rng.dirichlet([4, 1, 0.3], 300), rng.integers(1, 500, 300)
    table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens bigint, posterior array<double>").repartition(3)
    monkeypatch.setattr(mixing, "KEPT", kept)
    fit = mixing.solve(table, ["a", "b", "c"], [0.9, 0.1, 0.0], 1e-1)
    r = fit.moves.rates(p)
    assert fit.reached == pytest.approx((r * t) @ p)
    # each rate is what a full step of the ridge from it gives: the optimum's own condition
    full = np.maximum(0, 1 - p @ (fit.reached - fit.target) / fit.moves.weight)
    assert np.abs(full - r).max() <= mixing.TOLERANCE / 1e-1 * 1.01
    assert (r == 0).any() or r.min() < 0.9


def test_copies(spark):
    def hashed(doc_id, text):
        seed = 42
        if doc_id is not None:
            seed = xxhash.xxh64(int(doc_id).to_bytes(8, "little", signed=True), seed=seed).intdigest()
        if text is not None:
            seed = xxhash.xxh64(text.encode(), seed=seed).intdigest()
        return xxhash.xxh64(b"copies", seed=seed).intdigest() % (1 << 20)

    rows = [(i, f"text {i}", r) for i in range(400) for r in (0.0, 0.25, 1.0, 1.7)] + [(None, f"text {i}", 0.5) for i in range(200)] + [(5, None, 0.5), (None, None, 2.5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, rate double")
    got = [x.copies for x in table.select(mixing.copies_of(mixing.hash_of(F.col("doc_id"), F.col("text")), F.col("rate")).alias("copies")).collect()]
    assert got == [int(r) + (hashed(i, t) / (1 << 20) < r - int(r)) for i, t, r in rows]
    # rows without an id are told apart by their texts
    assert 60 < sum(got[1600:1800]) < 140


def test_met_by_each_target():
    fit = mixing.Fit(["a", "b", "c"], mixing.Moves(1.0, 1.0), np.array([900.0, 50.0, 0.0]), np.array([800.0, 100.0, 50.0]), np.array([905.0, 58.0, 3.0]), 0.0, 1)
    assert fit.met().tolist() == [True, False, False]

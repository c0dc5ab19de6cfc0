"""A training step of the language model against plain loops."""

from __future__ import annotations

import numpy as np

from newslake.llm import lm


def test_a_step_is_adagrad_on_the_log_probability():
    rng = np.random.default_rng(3)
    voc = lm.Vocabulary(900, 40, [(k << 40, k, 40 - k) for k in range(1, 40)], [(k, 40 - k, 1) for k in range(1, 40)])
    model, n = lm.MaxEnt(voc), 60
    model.weights = [rng.normal(0, 0.3, w.shape).astype(np.float32) for w in model.weights]
    features = rng.integers(0, 1 << 62, (7, 4)).astype(np.uint64)[rng.integers(0, 7, n)]
    unit = rng.integers(0, lm.CLASSES * lm.UNITS, n)
    rows = model.rows(features, unit // lm.UNITS)
    want = [w.astype(float) for w in model.weights]
    for level, hit in enumerate((unit // lm.UNITS, unit % lm.UNITS)):
        sums: dict[int, np.ndarray] = {}
        for t in range(n):
            z = want[level][rows[level][t]].sum(axis=0) + (model.bias[0] if level == 0 else model.bias[1][unit[t] // lm.UNITS])
            slope = -np.exp(z) / np.exp(z).sum()
            slope[hit[t]] += 1
            for r in rows[level][t]:
                sums[r] = sums.get(r, 0) + slope
        want[level] = want[level].copy()
        for r, x in sums.items():
            want[level][r] += lm.RATE * x / np.sqrt(1e-2 + x * x)
    square, uses = [np.full(w.shape, 1e-2, np.float32) for w in model.weights], [np.zeros(len(w), np.float32) for w in model.weights]
    model.learn(features, unit, square, uses)
    for level in (0, 1):
        assert np.allclose(model.weights[level], want[level], atol=2e-4)
        assert uses[level].sum() == 4 * n

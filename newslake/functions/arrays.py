"""Helpers on numpy arrays and ranges within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def groups_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about ``limit`` units in all, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

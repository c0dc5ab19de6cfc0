"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than space and the five ASCII controls from tab to return, with A-Z
lowered. Its hash is a sum of byte codes times multipliers that depend on the place in the word, mixed
to uniform bits: two words of a corpus share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from newslake.llm.common import groups_of, mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BATCH_BYTES = 1 << 19


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def segments(text: bytes, size: int = 8 * BATCH_BYTES) -> Iterator[bytes]:
    """``text`` cut at white space into parts of about ``size`` bytes, so that memory stays bounded."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the last two bytes of each (0: shorter), and the number of words of each text."""
    joined = b" ".join(texts)
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    data = LOWER[np.frombuffer(joined, np.uint8)]
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    counts = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), counts
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    lengths = ends - starts
    opened = np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    place = np.arange(len(data)) - opened
    code = CODES[data]
    code[space] = 0
    place[space] = 0
    hashes = mix64(np.add.reduceat(code * _multipliers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))
    last = data[ends - 1].astype(np.uint16)
    before = data[np.maximum(ends - 2, 0)].astype(np.uint16)
    suffix = np.where(lengths > 1, before * np.uint16(256) + last, last)
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, suffix, counts


def batches(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts with their words, in memory-bounded batches: start, end, hashes, suffixes, counts."""
    for i, j in groups_of([len(x) for x in texts], BATCH_BYTES):
        if j == i + 1 and len(texts[i]) > 8 * BATCH_BYTES:
            parts = [words([x]) for x in segments(texts[i])]
            yield i, j, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([sum(len(p[0]) for p in parts)])
        else:
            yield (i, j, *words(texts[i:j]))

"""Arrow and numpy helpers of the llm operators; written tables come from ``newslake.lake``."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newslake.functions.arrays import groups_of, mix64  # noqa: F401
from newslake.lake import forgotten, scratch_dir, written  # noqa: F401


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts as str, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8, null as the empty text; Arrow hands over the bytes without decoding them."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


PART = 1 << 22  # bytes of text that a task has as Python objects at once


def parts_of(rows: pa.RecordBatch | pa.Array, text: pa.Array, size: int | None = None) -> Iterator:
    """Slices of ``rows`` with about ``size`` bytes of their ``text`` each, one row at least."""
    for i, j in groups_of(pc.fill_null(pc.binary_length(text), 0).to_pylist(), size or PART):
        yield rows.slice(i, j - i)


def freed() -> None:
    """Give free memory back to the system: a worker waits beside the executor for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows (the last may have fewer) that do not cut a group of equal keys.

    The input is sorted by column ``key``, an integer without nulls.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=size)[0]
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], len(keys) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=size)[0]


def matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """Rows of equal numbers of ``kind`` from a binary column without nulls, without a copy."""
    if not len(column):
        return np.zeros((0, 1), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)

"""Tasks hold a bounded part of a batch's texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from newslake.llm import common


def test_parts_are_all_rows_in_bounded_slices():
    texts = [None, "", *("ä" * (i % 50) for i in range(400)), "x" * 3000, None]
    batch = pa.record_batch([pa.array(np.arange(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(common.parts_of(batch, batch.column(1), 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 1000 for p in parts)
    assert list(common.parts_of(batch.slice(0, 0), batch.slice(0, 0).column(1))) == []
    common.freed()

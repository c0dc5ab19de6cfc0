"""Packing writes and returns no more files than its documents and the session's cores need, whatever the shuffle."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pytest

from newslake.llm import packing
from newslake.llm.queries import BYTE_BPE

HELD = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def slots(rows) -> dict[int, list[tuple[int, int]]]:
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_few_files_of_many_shuffle_partitions(many, monkeypatch, parts):
    files, written = [], packing.written

    def counted(df):
        out = written(df)
        files.append(len(list(Path(out._scratch.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(packing, "written", counted)
    texts = [" ".join(["lake", "news", "of"][: 1 + i % 3] * (1 + i % 90)) if i % 11 else None for i in range(600)]
    got = packing.packed(many.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts), BYTE_BPE, capacity=128)
    rows, most = got.collect(), max(parts, many.sparkContext.defaultParallelism)
    assert sum(files) <= parts
    assert got.rdd.getNumPartitions() <= most
    assert sorted({r.doc_id for r in rows}) == list(range(600))
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    for found in slots(rows).values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= 128

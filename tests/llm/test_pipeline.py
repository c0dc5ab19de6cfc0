"""Each stage of the pipeline by brute force on the stage's own input, and the chain over odd and empty tables."""

import collections
import re
import unicodedata

import numpy as np
import pytest

import corpus_pipeline as P
from newslake.llm import mixing, secrets, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    """The documents before each stage and after the last, as written tables."""
    held = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in P.STAGES:
        held.append(P.written(stage(spark, held[-1], SF)))
    return held


def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_stages_are_the_five(chain):
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(t.columns == chain[0].columns for t in chain[:-1])


def test_language(chain):
    before, after = texts(chain[0]), texts(chain[1])
    assert after.items() <= before.items()
    for i, t in before.items():
        letters = any(unicodedata.category(c)[0] == "L" for c in t or "")
        assert letters or i not in after
    assert len(after) >= 0.99 * sum(any(c.isalpha() for c in t or "") for t in before.values())


def test_near_duplicates(chain):
    before = texts(chain[1])
    ids = sorted(before)
    prints = np.array([simhash.fingerprint((before[i] or "").encode()) for i in ids], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert sorted(texts(chain[2])) == sorted(set(label.tolist()))


def test_secrets(chain):
    rows = {r.doc_id: r for r in chain[2].collect()}
    found, owners, repositories = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(set)
    for i, r in rows.items():
        for kind, pattern, group, least in secrets.KINDS:
            for m in re.finditer(pattern, r.text or "", re.A):
                own = m[group]
                if len(own) >= least:
                    found[i].append((m.start(), m.end(), kind, own))
                    owners[own].add(r.source)
                    repositories[own].add((r.source, r.lang))
    after = texts(chain[3])
    assert after.keys() == rows.keys()
    for i, r in rows.items():
        live = []
        for a, b, kind, own in sorted(found[i]):
            long_key = kind == "pem" and len(own) >= secrets.LONG_PEM
            random = len(set(own)) >= secrets.MIN_VARIETY and (long_key or not re.search(secrets.PLACEHOLDER, own.lower()))
            if random and len(owners[own]) <= secrets.MAX_OWNERS and len(repositories[own]) <= secrets.MAX_REPOSITORIES:
                if live and a < live[-1][1]:
                    live[-1][1] = max(live[-1][1], b)
                else:
                    live.append([a, b])
        out = r.text
        for a, b in reversed(live):
            out = out[:a] + "[SECRET]" + out[b:]
        assert after[i] == out, i
    assert any("[SECRET]" in (t or "") for t in after.values())


def test_mixing(spark, chain):
    copies = {r.doc_id: r.copies for r in mixing.rated(chain[3], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    times = collections.Counter(r.doc_id for r in chain[4].select("doc_id").collect())
    assert times == collections.Counter({i: n for i, n in copies.items() if n})
    assert texts(chain[4]).items() <= texts(chain[3]).items()


def test_packing(chain):
    rows = chain[5].collect()
    assert sum(r.piece == 0 for r in rows) == chain[4].count() and all(0 < r.length <= 2048 for r in rows)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    # no two sequences of half their size or less: best fit would have joined them
    assert sum(sum(n for _, n in v) <= 1024 for v in used.values()) <= 1


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_go_through_all_stages(spark, odd, none, tmp_path, empty):
    (none if empty else odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty else [(100, 1, 0), (101, 0, 0), (102, 1, 1), (None, 1, 0), (103, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    assert (got.count() == 0) == empty

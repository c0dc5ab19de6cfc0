"""SimHash components and nearest neighbours against brute force; the pipeline's stages."""

import zlib

import numpy as np
import pytest
import xxhash

from newslake.llm import ann, langid, mixing, secrets, simhash

SF = "/root/testdata/sf0.001"


def brute_components(prints, ids):
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    text = "One two  two three\tTWO three É".encode()
    words = text.lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(b"a B") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("dense", [False, True])
def test_trees_lose_no_link(dense):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40 if dense else 1500, dtype=np.uint64)
    near = base[rng.integers(0, len(base), 3000)].copy()
    for _ in range(3):
        near ^= (rng.integers(0, 2, len(near), dtype=np.uint64)) << rng.integers(0, 64, len(near), dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near]))
    edges = []
    for half in (0, 1):
        tree, leaves = simhash.build((prints[::3] >> np.uint64(32 * half)).astype(np.uint32), 60)
        at, leaf = simhash.shards_of((prints >> np.uint64(32 * half)).astype(np.uint32), tree)
        for k in range(leaves):
            a, b, left = simhash.shard_links(np.unique(prints[at[leaf == k]]), half)
            assert not left
            edges += zip(np.searchsorted(prints, a).tolist(), np.searchsorted(prints, b).tolist())
    union = simhash._Union(len(prints))
    union.link(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert [union.find(i) for i in range(len(prints))] == brute_components(prints, range(len(prints))).tolist()


@pytest.mark.parametrize("spread", [8, 28])
def test_dense_balls_over_tasks(spark, monkeypatch, spread):
    """Fingerprints that no vantage point parts: many within a few bits of each other in one half, or in both."""
    rng = np.random.default_rng(5)
    n = 3000
    bits = lambda low, high, k: np.bitwise_or.reduce([np.uint64(1) << rng.integers(low, high, n, dtype=np.uint64) for _ in range(k)])
    prints = np.unique(bits(32, 64, 1) ^ bits(0, 32, 1) ^ rng.integers(0, 2 ** (spread // 2), n, dtype=np.uint64))
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "LEAF", 32)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print bigint")
    found = simhash.links(table).collect()
    union = simhash._Union(len(prints))
    ends = np.searchsorted(prints, np.array([(r.a, r.b) for r in found], np.int64).view(np.uint64))
    union.link(ends[:, 0], ends[:, 1])
    assert [union.find(i) for i in range(len(prints))] == brute_components(prints, range(len(prints))).tolist()


def test_fingerprints_of_very_long_texts():
    import resource

    rng = np.random.default_rng(6)
    words = [f"w{k}".encode() for k in rng.integers(0, 9000, 400_000)]
    text = b"  ".join(words)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    ones = np.array([(hashes >> np.uint64(63 - k) & np.uint64(1)).sum() for k in range(64)])
    assert simhash.fingerprint(text) == int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    simhash.fingerprint(b"one two three " * 700_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_columns_with_clashing_names(spark):
    names = ["doc_id", "text", "lang", "source", "a.b", "_kept", "_rows", "_row", "id", "row", "kept", "of", "n", "print", "least", "told", "document", "matched"]
    rows = [(i, f"one two three four {i % 3}", "en", f"s{i}", *range(14)) for i in range(6)] + [(None, "token=abcdef123456 x", "en", "s", *range(14))]
    table = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c in ('text', 'lang', 'source') else 'bigint'}" for c in names))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    for stage in (langid.rejected_out, simhash.keep_one, secrets.redacted, lambda d: mixing.mixed(d, labels)):
        got = stage(table)
        assert got.columns == names and got.count() > 0
        assert all(tuple(r)[4:] == tuple(range(14)) for r in got.collect())


def test_near_duplicates(spark, odd, odd_rows, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, simhash.near_duplicates(rows).collect()))
    texts = {r.doc_id: r.text for r in rows.collect()}
    prints = [simhash.fingerprint(texts[i].encode()) for i, *_ in got]
    assert [f for _, f, _ in got] == [f"{p:016x}" for p in prints]
    assert [c for *_, c in got] == brute_components(prints, [i for i, *_ in got]).tolist()
    own = simhash.near_duplicates(odd).collect()
    assert len(own) == len(odd_rows)
    assert {r.component_id for r in own if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 2 not in ids and 6 in ids and 1 in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[50:110] = x[40]
    rows = [(i, v.tolist(), 1, 2.0) for i, v in enumerate(x)] + [(2000, None, 1, 1.0), (2020, [0.0] * 16, 1, 1.0), (2040, [float("nan")] * 16, 1, 1.0), (2060, [1.0, None] * 8, 1, 1.0), (None, [1.0] * 16, 1, 1.0), (2080, [1.0] * 5, 1, 1.0), (2081, [2.0] * 5, 1, 1.0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int, sim double")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y = x.astype(np.float64)
    found = []
    for q in range(0, 700, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -np.round(s, 9)))[:20]
        own = [got[q][k][0] for k in range(1, 21)]
        assert [got[q][k][1] for k in range(1, 21)] == pytest.approx(s[own].tolist())
        if q in (40, 60, 80, 100):
            assert own == [i for i in [40, *range(50, 110)] if i != q][:20]
        found.append(len(set(own) & set(want.tolist())) / 20)
    assert got.pop(2080) == {1: (2081, 10.0)}  # among vectors of its own length
    assert len(got) == 35 and np.mean(found) > 0.95


def test_nearest_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(table).orderBy("query_id", "rank").collect()] == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]
    assert ann.nearest(table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), None
    names = docs.columns
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF))
        assert docs.columns == names and docs.count() > 0, name
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(i) == (1, 1) for i in ids)
    assert docs.select("doc_id").distinct().count() <= before
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.filter("piece = 0").count() == docs.count()

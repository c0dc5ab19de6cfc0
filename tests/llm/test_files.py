"""Media, token files and packing: exact round trips and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newslake.llm import arrowfile, bpe, media, packing
from newslake.llm.queries import BYTE_BPE, WORD_BPE

TEXTS = ["", " ", "\n", " a", "a ", "a  b", "a\n\nb c\n", "a \nb", "a\n b", "don't I'LL \n\n x", "İstanbul Σας ΑΣ", "ｆｕｌｌ 漢字 x", "<|endoftext|>a", "a\tb", "éa É", "x\n", "1234 5.6%%% &&&!", "ª²³", "a\x1cb\x85c", "naïve—word… “q”", "é é"]


@pytest.mark.parametrize("kind,path", [("byte", BYTE_BPE), ("word", WORD_BPE)])
def test_ids_are_the_tokenizers(kind, path):
    own, whole = bpe.tokenizer(kind, path), Tokenizer.from_file(path)
    for text in TEXTS + [a + " " + b for a in TEXTS for b in TEXTS]:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind,path", [("byte", BYTE_BPE), ("word", WORD_BPE)])
def test_ids_of_any_script(kind, path, monkeypatch):
    own, whole, rng = bpe.Encoder(path, kind == "word"), Tokenizer.from_file(path), random.Random(1)
    signs = " \n\t\r\x0b\x00\x1c\x85\xa0 \u180e\u2028\u3000\u200b'sabÉΣç漢字1²½e\u0301!._-İß|<>😀"
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(3000)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(texts)] == want
    # with full caches and in segments too
    monkeypatch.setattr(bpe, "SEGMENT", 40)
    monkeypatch.setattr(bpe, "CACHE", 30)
    assert [x.tolist() for x in own.encode_batch(texts)] == want
    long = " ".join(texts)
    assert own.encode(long).tolist() == whole.encode(long, add_special_tokens=False).ids


def test_png_filters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    rows = np.zeros((40, 17), np.uint8)
    for i in range(40):
        kind = i % 5
        rows[i, 0] = kind
        for j in range(16):
            a = int(image[i, j - 1]) if j else 0
            b = int(image[i - 1, j]) if i else 0
            c = int(image[i - 1, j - 1]) if i and j else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[i, j + 1] = (int(image[i, j]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255
    assert (media.unfilter(rows) == image).all()
    simple = rows[rows[:, 0] < 3]
    assert media.unfilter(simple).shape == (len(simple), 16)


def test_png_round_trip_and_checksums():
    for data in (b"", b"a" * 64, bytes(range(256)) * 5, b"text " * 999):
        made = media.png_encode(media.padded(data))
        assert media.png_decode(made).tobytes() == media.padded(data)
    bad = bytearray(made)
    bad[60] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(bad))
    with pytest.raises(ValueError):
        media.png_decode(made[:-20])
    assert struct.unpack(">II", made[16:24]) == (64, len(media.padded(data)) // 64)


def test_media_rows(odd, odd_rows, none):
    got = {r.doc_id: r for r in media.media_columns(odd).collect()}
    for i, t, *_ in odd_rows:
        data = (t or "").encode()
        pad = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        made = media.png_encode(pad)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(made).hexdigest(), len(made))
    assert got[1].feature == got[2].feature
    assert media.media_columns(none).count() == 0


def test_media_comes_from_the_stored_column(odd):
    """A change of the stored bytes shows in what is read back; a broken checksum stops the job."""
    kept = media.stored(odd)
    assert dict(kept.dtypes)["media"] == "binary" and "parquet" in kept.inputFiles()[0]
    other = kept.withColumn("media", F.lit(bytearray(media.png_encode(b"z" * 128))))
    assert {r.payload_sha256 for r in media.read_back(other).collect()} == {hashlib.sha256(b"z" * 128).hexdigest()}
    bad = bytearray(media.png_encode(b"z" * 128))
    bad[-20] ^= 1
    with pytest.raises(Exception, match="checksum"):
        media.read_back(kept.withColumn("media", F.lit(bad))).collect()


def test_token_files(spark, odd, odd_rows, none, tmp_path):
    folder = f"{tmp_path}/files"
    got = arrowfile.encoded(odd, WORD_BPE, width=16, folder=folder).collect()
    whole, at, want = Tokenizer.from_file(WORD_BPE), 0, []
    for i, t, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    name = next(f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".arrow"))
    shard = arrowfile.ShardReader(pafs.LocalFileSystem(), name.removesuffix(".arrow"))
    ids, mask = shard.row(0)
    assert ids.base is not None and len(ids) == 16 and mask.all()
    assert isinstance(shard.file.schema.field("ids").type, pa.FixedSizeListType)
    last, mask = shard.row(int(shard.first[-1]) - 1)
    assert mask.sum() == (shard.docs.column("n_tokens").to_numpy().sum() - 1) % 16 + 1
    assert arrowfile.encoded(none, WORD_BPE).count() == 0


def test_best_fit_counts():
    rng = np.random.default_rng(1)
    for capacity in (10, 64):
        lengths = rng.integers(1, capacity + 1, 500)
        counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
        plan = packing.best_fit(counts, capacity)
        # the same by items
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [(r, k) for k, r in enumerate(bins) if r >= n]
            if fit:
                bins[min(fit)[1]] -= n
            else:
                bins.append(capacity - n)
        used = {}
        for (length, rank, start, fit, offset), end in zip(plan, [*plan[1:], None]):
            last = end[1] if end and end[0] == length else counts[length]
            for k in range(last - rank):
                used.setdefault(start + k // fit, []).append((offset + k % fit * length, length))
        assert sum(len(v) for v in used.values()) == 500
        for v in used.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= capacity
        assert len(used) == len(bins)


def test_packed(odd, odd_rows, none):
    got = packing.packed(odd, BYTE_BPE, capacity=128).collect()
    whole = Tokenizer.from_file(BYTE_BPE)
    want = []
    for i, t, *_ in odd_rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 128 + 1
        for p, (a, b) in enumerate([(0, first), *((s, s + 128) for s in range(first, len(ids), 128))]):
            want.append((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:k]) for k, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 128
    assert packing.packed(none, BYTE_BPE).count() == 0

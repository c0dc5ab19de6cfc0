"""Media columns: texts as greyscale PNG images in binary columns, read back and hashed.

A payload of bytes becomes an 8-bit greyscale PNG of 64 samples a row. Rows are filtered (none, sub or
up, whichever leaves the smallest residue), deflated into IDAT chunks and closed by IEND. The reader
tests the signature and each chunk's checksum, inflates, undoes all five filter types in numpy, and
computes a 64-bit hash from the low frequencies of the two-dimensional cosine transform.

``stored`` writes the images as a binary column of a table in the shared folder and ``read_back`` computes
digests and features from that column alone; ``media_columns`` does both.

Null and empty texts give one row of zero samples. Very long texts give tall images; a document's text, image
and samples are in memory together. Equal texts give equal bytes. Nothing is shared between rows, so repeated
rows, null ids and empty tables need no special case; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import bytes_of, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the row width."""
    rows = max(1, -(-len(data) // WIDTH))
    return data.ljust(rows * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(image: np.ndarray) -> np.ndarray:
    """Rows with their filter type in front: none, unless another leaves a far smaller sum of absolute residues.

    Deflate finds words in raw text that residues hide, so only flat or repeating rows are filtered.
    """
    left, above = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:], above[1:] = image[:, :-1], image[:-1]
    options = np.stack([image, image - left, image - above])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    cost[1:] *= 4
    best = cost.argmin(axis=0)
    out = np.empty((len(image), image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(len(image))]
    return out


def png_encode(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG whose samples are ``payload``, a positive multiple of ``width`` bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(_filtered(image).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the filters of rows that have their type in front, for one byte a pixel.

    Sub is a running sum along a row and Up one down a column, both modulo 256, so any mix of None,
    Sub and Up takes two cumulative sums over the image. Average and Paeth need the row above.
    """
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter type")
    sub = kinds == 1
    data[sub] = np.cumsum(data[sub], axis=1, dtype=np.uint8)
    if kinds.max(initial=0) <= 2:
        total = np.zeros((len(data) + 1, data.shape[1]), np.uint8)
        np.cumsum(data, axis=0, dtype=np.uint8, out=total[1:])
        at = np.arange(len(data))
        start = np.maximum.accumulate(np.where(kinds == 2, 0, at))
        return total[1:] - total[start]
    # samples whose row and column add up to the same number depend on earlier such numbers alone
    n, width = data.shape
    out = np.zeros((n + 1, width + 1), np.int16)  # with a row above and a column to the left
    for d in range(n + width - 1):
        i = np.arange(max(0, d - width + 1), min(n, d + 1))
        j = d - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[i], [np.int16(0), np.where(sub[i], np.int16(0), left), up, (left + up) // 2, paeth])
        out[i + 1, j + 1] = (data[i, j] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def png_decode(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; ValueError on a bad signature, chunk, checksum or size."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, packed, ended = 8, 0, 0, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut PNG chunk")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"bad checksum in PNG chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit greyscale PNG without interlace")
        elif kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    raw = zlib.decompress(b"".join(packed)) if ended and packed else b""
    if not width or len(raw) != height * (width + 1):
        raise ValueError("PNG without all its rows")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(size: int, kept: int) -> np.ndarray:
    k, x = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size)) * np.where(k == 0, 1, 2**0.5) / size**0.5


GRID, KEPT = 32, 8
COSINES = _cosines(GRID, KEPT)


def _pooled(image: np.ndarray, size: int) -> np.ndarray:
    """Means over ``size`` equal bands of rows; a band's edge may cut a row."""
    total = np.zeros((len(image) + 1, image.shape[1]))
    np.cumsum(image, axis=0, dtype=np.float64, out=total[1:])
    edge = np.linspace(0, len(image), size + 1)
    low = np.minimum(edge.astype(np.int64), len(image) - 1)
    at = total[low] + (edge - low)[:, None] * image[low]
    return np.diff(at, axis=0) * (size / len(image))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine coefficients exceed the median of the 63 without the mean."""
    small = _pooled(_pooled(image, GRID).T, GRID).T
    low = (COSINES @ small @ COSINES.T).ravel()
    low = np.round(low, 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def stored(documents: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes and media (a PNG) of each row, written to the shared folder and read from it."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(1))
            yield from _sized(batch.column(0), ({"n_bytes": len(x), "media": png_encode(padded(x))} for x in texts), STORED)

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return written(rows.mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary"))


def read_back(images: DataFrame) -> DataFrame:
    """Digests and the cosine hash of each image in ``images`` (doc_id, n_bytes, media), from its samples."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sized(batch.column(0), map(digests, batch.column(1).to_pylist(), batch.column(2).to_pylist()), READ)

    return images.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, feature_bits binary")


def digests(n_bytes: int, media: bytes) -> dict:
    image = png_decode(media)
    back, bits = image.tobytes(), cosine_hash(image)
    return {"n_bytes": n_bytes, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": bits.hex(), "feature_bits": bits}


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("feature_bits", pa.binary())])
OUT_ROWS = 1000


def _sized(ids: pa.Array, rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` (without doc_id) and their ``ids``, of few rows each so that images do not pile up."""
    for i in range(0, len(ids), OUT_ROWS):
        own = ids.slice(i, OUT_ROWS)
        held = list(islice(rows, len(own)))
        yield pa.RecordBatch.from_arrays([own, *(pa.array([r[f.name] for r in held], f.type) for f in list(schema)[1:])], schema=schema)


def media_columns(documents: DataFrame) -> DataFrame:
    """Digests and features of each text's stored image."""
    return read_back(stored(documents))

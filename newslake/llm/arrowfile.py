"""Token ids in Arrow files of fixed-size-list batches.

All documents' ids in ascending doc_id order form one stream, written as shards. A shard is an Arrow
IPC file whose record batches hold two fixed-size lists of ``width`` values a row: ``ids`` and
``mask``; only the last row of a shard is padded (mask false). Rows of equal length make any position
plain arithmetic, and a memory-mapped batch gives its values without a copy. A second small file has
the documents of the shard with their first position and length.

Shards are range partitions by doc_id, sorted, so they follow each other in order; rows of one doc_id come in
order of a hash of their text.
A shard is written under a name of its own and renamed when whole; a task that runs again
writes the same bytes. Files go to the shared folder through ``pyarrow.fs``.

Null and empty texts have the end id alone; very long texts run over as many rows as they need. Rows with a null doc_id come first. Repeated rows are
written each. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslake.llm.bpe import tokenizer
from newslake.llm.common import freed, parts_of, scratch_dir, texts_of, written

WIDTH = 1024
ROWS = 256  # rows of a record batch


#: Names of a store in Spark's connectors and in Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark resolves it, with the scheme of its file system: a path without one is not always local."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"no Arrow file system for {uri!r}")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def _schema(kind: np.dtype, width: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), width)), ("mask", pa.list_(pa.bool_(), width))])


class ShardWriter:
    """Appends ids of documents to a shard; ``close`` makes both files visible."""

    def __init__(self, folder: str, name: str, kind: np.dtype, width: int = WIDTH):
        self.fs, self.folder = _place(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.kind, self.width = f"{self.folder}/{name}", np.dtype(kind), width
        self.temp = f"{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.temp}.arrow")
        self.schema = _schema(self.kind, width)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids.astype(self.kind))
        self.n_held, self.total = self.n_held + len(ids), self.total + len(ids)
        if self.n_held >= ROWS * self.width:
            self._flush(self.n_held - self.n_held % self.width)

    def _flush(self, n: int, pad: int = 0) -> None:
        held = np.concatenate([*self.held, np.zeros(pad, self.kind)])
        mask = np.ones(n, bool)
        mask[n - pad :] = False
        for at in range(0, n, ROWS * self.width):
            end = min(n, at + ROWS * self.width)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:end]), self.width) for x in (held[:n], mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n_held = [held[n:]], len(held) - n

    def close(self) -> str:
        if self.n_held:
            pad = -self.n_held % self.width
            self._flush(self.n_held + pad, pad)
        self.file.close()
        self.out.close()
        columns = [pa.array(x, pa.int64()) for x in zip(*self.docs)] if self.docs else [pa.array([], pa.int64())] * 3
        with self.fs.open_output_stream(f"{self.temp}.docs") as out:
            table = pa.table(columns, names=["doc_id", "start", "n_tokens"])
            with pa.ipc.new_file(out, table.schema) as file:
                file.write_table(table)
        self.fs.move(f"{self.temp}.docs", f"{self.name}.docs")
        self.fs.move(f"{self.temp}.arrow", f"{self.name}.arrow")
        return self.name


class ShardReader:
    """Random access to a shard: rows by number, positions by arithmetic, documents by their place."""

    def __init__(self, fs: pafs.FileSystem, name: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = (lambda x: pa.memory_map(x)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(opened(f"{name}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{name}.docs")).read_all()
        self.width = self.file.schema.field("ids").type.list_size
        sizes = [self.file.get_batch(i).num_rows for i in range(self.file.num_record_batches)]
        self.first = np.cumsum([0, *sizes])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i`` (a view of the file's memory) and its mask."""
        at = int(np.searchsorted(self.first, i, "right")) - 1
        batch, k = self.file.get_batch(at), i - self.first[at]
        return self._ids(batch)[k * self.width : (k + 1) * self.width], np.asarray(batch.column(1)[k].values)

    def _ids(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; a view if they lie in one batch."""
        parts, end = [], start + n
        while start < end:
            at = int(np.searchsorted(self.first, start // self.width, "right")) - 1
            base = int(self.first[at]) * self.width
            values = self._ids(self.file.get_batch(at))[start - base : end - base]
            parts.append(values)
            start += len(values)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


def write_shards(documents: DataFrame, folder: str, encode: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]], end_id: int, kind: str, width: int = WIDTH) -> DataFrame:
    """Write all documents; one row a shard: shard, name, n_docs, n_tokens. Evaluate it once (``written``)."""
    end = np.array([end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, shard = encode(), TaskContext.get().partitionId(), None
        for batch in (part for whole in batches for part in parts_of(whole, whole.column(1))):
            for doc_id, found in zip(batch.column(0).to_pylist(), ids_of(texts_of(batch.column(1)))):
                shard = shard or ShardWriter(folder, f"shard-{part:06d}", np.dtype(kind), width)
                shard.append(doc_id, np.concatenate([found, end]))
        if shard:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int64()), "name": [shard.close()], "n_docs": pa.array([len(shard.docs)], pa.int64()), "n_tokens": pa.array([shard.total], pa.int64())})
        freed()

    # ties of ids by a hash of the text and the row's place, so that no id is bound to one task
    order = ["doc_id", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place")]
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(*order, "text")
    keys = ["doc_id", "mark", "place"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(write, "shard bigint, name string, n_docs bigint, n_tokens bigint")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Each document's place in the whole stream, length and checksum, read back from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row a file
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = ShardReader(fs, name)
                start, n = (shard.docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(shard.span(int(a), int(k)).astype("<u4")) for a, k in zip(start, n)]
                columns = [shard.docs.column("doc_id").combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = based.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.select("name", "base").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(documents: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 2, ids: str = "uint16", width: int = WIDTH, folder: str | None = None) -> DataFrame:
    """Write ``documents`` as shards below ``folder`` (a new one in the shared folder) and read all of them back."""
    folder = qualified(documents.sparkSession, folder or scratch_dir(documents.sparkSession))
    shards = written(write_shards(documents, folder, lambda: tokenizer(kind, tokenizer_path).encode_batch, end_id, ids, width))
    return read_documents(shards, folder)

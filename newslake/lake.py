"""The cluster's shared folder and tables written to it between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders named within each scope that is open in this thread of work; other threads have scopes of their own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())


def scratch_dir(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``; a local folder stands in only on a local master that has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/newslake-{uuid.uuid4().hex}"
    for held in _open.get():
        held.append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote for ``tables``, which nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            removed(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at its end every scratch folder that was named within; results must be stored elsewhere by then."""
    held: list[str] = []
    token = _open.set((*_open.get(), held))
    try:
        yield
    finally:
        _open.reset(token)
        for path in held:
            removed(spark, path)

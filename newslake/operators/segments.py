"""Kept tables in parts: parquet folders, and a numbered commit that lists those which make up the table.

A change writes new folders and then one commit file, whose name is the next number. It is moved into place under a
name that must not exist: of two writers that began from the same version one gets ``Conflict`` and starts again,
and a crash leaves a folder that no commit names. Readers take the last commit and see whole changes only. The folder must
be on a file system that all executors share and whose rename does not overwrite (HDFS, a local disk).
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer committed this version first."""


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str):  # noqa: ANN202
        return self._hadoop.Path("/".join((self.path, *parts)))

    def state(self) -> tuple[int, list[dict[str, Any]]]:
        """The last version and its entries; version 0 is an empty table."""
        if not self._fs.exists(self._at("log")):
            return 0, []
        last = max((x.getPath().getName() for x in self._fs.listStatus(self._at("log")) if x.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return 0, []
        return int(last.removesuffix(".json")), self._entries(last)

    def _entries(self, name: str) -> list[dict[str, Any]]:
        stream = self._fs.open(self._at("log", name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def stored(self, rows: DataFrame, kind: str, partition: str | None = None, **facts: Any) -> dict[str, Any]:
        """Write ``rows`` to a folder of their own; they are in the table once a commit lists the entry."""
        folder = f"{kind}/part=p{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(partition) if partition else rows.write
        writer.parquet(f"{self.path}/{folder}")
        return {"kind": kind, "folder": folder, **facts}

    def commit(self, after: int, entries: list[dict[str, Any]]) -> int:
        """Make ``entries`` the table, if ``after`` is still its version; the new version."""
        name = f"{after + 1:012d}.json"
        fresh = self._at("log", f"new-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._at("log", name)), options)
        except Exception as error:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {after + 1} of {self.path} is there already") from error
            raise
        return after + 1

    def read(self, entries: list[dict[str, Any]], kind: str, schema: str) -> DataFrame:
        """All rows of the entries of a kind, in one scan."""
        folders = [f"{self.path}/{e['folder']}" for e in entries if e["kind"] == kind]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders).drop("part")

    def vacuumed(self, keep: int = 2) -> int:
        """Remove folders that none of the last ``keep`` commits lists; the number of those removed. Not beside a writer."""
        if not self._fs.exists(self._at("log")):
            return 0
        logs = sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("log")) if x.getPath().getName().endswith(".json"))
        held = {e["folder"] for log in logs[-keep:] for e in self._entries(log)}
        kinds = [x.getPath().getName() for x in self._fs.listStatus(self._at()) if x.getPath().getName() != "log"]
        gone = [x.getPath() for kind in kinds for x in self._fs.listStatus(self._at(kind)) if f"{kind}/{x.getPath().getName()}" not in held]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

"""Structured Streaming forms of keyed and windowed operators (R1, R4, R7, R12, S10 of the pipeline).

A table is read as a file stream; ``available`` drains what there is and stops, so the same job
serves tests, backfills and, with another trigger, a running service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newslake.lake import scratch_dir
from newslake.operators import folds as FO


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` as a stream, be it one file or a folder; timestamps are UTC."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    single = batch.inputFiles()[0].rstrip("/").endswith(f"/{name}.parquet")
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in batch.dtypes))


def available(stream: DataFrame, mode: str, schema: str | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run ``stream`` over all there is into a table of the shared folder, and read that.

    A batch has a folder of its own, which a batch that runs again overwrites: each row is there once.
    """
    spark = stream.sparkSession
    out, state = scratch_dir(spark), scratch_dir(spark)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink or batch_writer(out, mode)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def batch_writer(out: str, mode: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to a folder of its number below ``out``; with complete output all batches share one."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch-{number:012d}'}")

    return write


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "48 hours") -> DataFrame:
    """Counts by event time and type, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def idempotent(events: DataFrame, keys: list[str], within: str = "48 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def health(attempts: DataFrame) -> DataFrame:
    """The health machine as keyed state: a row for each source and batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: dict[str, Any] = FO.health_start()
        if state.exists:
            status, fails, oks, code, until = state.get
            own = {"status": status, "fails": fails, "oks": oks, "code": code, "until": until}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = None
        for row in rows.itertuples(index=False):
            out = FO.health_step(own, row)
        until = own["until"]
        state.update((own["status"], own["fails"], own["oks"], own["code"], None if until is None or pd.isna(until) else until.to_pydatetime()))
        yield pd.DataFrame([out])

    return attempts.groupBy("source_id").applyInPandasWithState(run, FO.HEALTH_SCHEMA, "status string, fails int, oks int, code int, until timestamp", "append", GroupStateTimeout.NoTimeout)

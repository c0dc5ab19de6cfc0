"""Scratch tables, tables with versions, streams that run a batch again, and the entry without the llm libraries."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from newslake import lake
from newslake.operators import store
from newslake.streaming import jobs

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scope_removes_what_was_written(spark):
    with lake.scope(spark):
        kept = lake.written(spark.range(5))
        assert kept.count() == 5 and os.path.isdir(kept._scratch)
    assert not os.path.exists(kept._scratch)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5, 7, 9):
        store.replaced(spark.range(n), path)
        assert store.current(spark, path).count() == n
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 2
    # a write that fails leaves the table as it was
    with pytest.raises(Exception, match="broken"):
        store.replaced(spark.range(4).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert store.current(spark, path).count() == 9


def test_a_batch_that_runs_again_is_written_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(20).write.parquet(source)
    write, failed = jobs.batch_writer(out, "append"), []

    def twice(batch, number):
        write(batch, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("lost")

    def run():
        q = spark.readStream.schema("id bigint").parquet(source).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(twice).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert failed and spark.read.option("recursiveFileLookup", True).parquet(out).count() == 20


@pytest.mark.parametrize("hidden", ["public_tokenizers", "newslake.llm", "corpus_pipeline"])
def test_entry_without_a_library(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len([q for q in e.queries() if not q.startswith('op')]))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=TOP, env=os.environ | {"PYTHONPATH": os.pathsep.join([TOP, os.environ.get("PYTHONPATH", "")])}, capture_output=True, text=True)
    assert ran.returncode == 0 and int(ran.stdout) > 150, ran.stderr


def test_scopes_of_two_threads(spark):
    """A scope removes what its own thread wrote, not what another's still reads."""
    import threading

    from newslake.lake import scope, written

    opened, ended, kept = threading.Event(), threading.Event(), {}

    def other():
        with scope(spark):
            kept["table"] = written(spark.range(5))
            opened.set()
            ended.wait(60)
            kept["rows"] = kept["table"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with scope(spark):
        opened.wait(60)
        written(spark.range(3))
    ended.set()
    thread.join()
    assert kept["rows"] == 5

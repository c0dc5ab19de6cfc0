"""Tables with upserts, cascades, retention and erasure (K1-K9).

Parquet has no MERGE, so a change of a table is a new version of it: the union of what is there and
what comes, one row a key. Callers write it with ``replaced``, which points to the new folder only once it
is whole, and read it with ``current``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str, kept: list[str] | None = None) -> DataFrame:
    """K1, K2: the last row of each key by ``order``, changes before what is there; columns in ``kept`` stay as first written."""
    kept = kept or []
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    first = Window.partitionBy(*keys).orderBy("_new", order)
    for c in kept:
        rows = rows.withColumn(c, F.first(c, ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("_place", last).filter("_place = 1").drop("_place", "_new")


def inserted_or_ignored(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K8, K9: new keys only, the first of each."""
    new = rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(new)


def cascaded(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """K3, K5: each table (DataFrame, its key column) without the keys in ``gone`` (column key)."""
    return {name: rows.join(gone.select(F.col("key").alias(column)).distinct(), column, "left_anti") for name, (rows, column) in tables.items()}


def retained(rows: DataFrame, column: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """K4: what stays, and a report of what goes; rows without a date stay."""
    old = F.coalesce(F.col(column) < cutoff, F.lit(False))
    return rows.filter(~old), rows.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def exported(rows: DataFrame, key: str) -> DataFrame:
    """K5: one JSON document a key with its rows, in order."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("json"))


def replaced(rows: DataFrame, path: str, kept: int = 2) -> None:
    """Make ``rows`` the table at ``path``: a new version in a folder of its own, then one rename of the pointer to it.

    Readers (``current``) see the old table or the new one, and a crash at any point leaves one of them. The
    last ``kept`` versions stay for those that still read them.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((path, *p)))
    fs = at().getFileSystem(conf)
    name = f"v-{jvm.java.lang.System.currentTimeMillis():015d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{name}")
    new = at(f"new-{name}")
    out = fs.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(at("CURRENT")), overwrite)
    versions = sorted(x.getPath().getName() for x in fs.listStatus(at()) if x.getPath().getName().startswith("v-"))
    for old in versions[: -kept]:
        if old != name:
            fs.delete(at(old), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replaced`` last made at ``path``."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}")


def user_state(actions: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """K7: of actions (user_id, item, event_type, ts, event_id) each user's history, bookmarks and preference.

    A view adds to the history once an item; a click sets and an error clears a bookmark, the last one counts; a
    signup states the preferred item, the last one counts. ``keep`` stores the aggregates that are joined.
    """
    when = F.struct("ts", "event_id")
    kind = lambda *names: actions.filter(F.col("event_type").isin(*names))
    read = kind("view").select("user_id", "item").distinct().groupBy("user_id").agg(F.count("*").alias("read"))
    marks = kind("click", "error").groupBy("user_id", "item").agg(F.max_by("event_type", when).alias("last"))
    marks = marks.groupBy("user_id").agg(F.count_if(F.col("last") == "click").alias("bookmarks"))
    wish = kind("signup").groupBy("user_id").agg(F.max_by("item", when).alias("preferred"))
    users = actions.select("user_id").distinct()
    out = users.join(keep(read), "user_id", "left").join(keep(marks), "user_id", "left").join(keep(wish), "user_id", "left")
    return out.select("user_id", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"), "preferred")

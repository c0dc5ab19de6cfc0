"""Order statistics of large groups (A18, A12): values at ranks, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.lake import written


def at_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the value at sorted place floor(n * share), at most n - 1, by the name of the share.

    Rows are range-partitioned by (group, value); a place is found by the counts of partitions before it.
    """
    ranged = written(rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")).repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in shares.items())))
    wanted = counts.select("g", "part", "before", "n", "total", named.alias("s")).withColumn("k", F.least(F.floor(F.col("total") * F.col("s.p")), F.col("total") - 1))
    wanted = wanted.filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))).select("g", "part", F.col("s.name").alias("name"), (F.col("k") - F.col("before") + 1).alias("place"))
    placed = ranged.join(wanted.select("g", "part").distinct(), ["g", "part"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("g", "part").orderBy("v")))
    return placed.join(wanted, ["g", "part", "place"]).groupBy(F.col("g").alias(group)).pivot("name", list(shares)).agg(F.first("v"))

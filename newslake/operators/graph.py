"""Connected components and breadth-first search over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.lake import forgotten, written


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of ``edges`` (a, b) reaches: columns node, root.

    Large-star and small-star steps until nothing moves. Minima are grouped and joined back, so a node
    with many neighbours is never one group in a task.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        old, edges = edges, written(small.filter("a <> b").distinct())
        forgotten(old, low, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Nodes reached from ``seeds`` (node) along ``links`` (a, b), with the least depth."""
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(links, front["node"] == links["a"]).select(F.col("b").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = written(seen.union(front))
    return seen

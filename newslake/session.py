"""Session defaults: UTC, adaptive plans, skew joins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "newslake", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; ``conf`` overrides or adds."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()

"""A Spark session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "shardloom", **conf: str) -> SparkSession:
    """A session in UTC with ANSI checks and adaptive execution; `conf` adds or overrides settings
    (underscores in names stand for dots)."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

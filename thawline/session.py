"""Session defaults: UTC, adaptive execution, Arrow exchange."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "thawline", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Session builder and the few session settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "veritrail", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; on a cluster give no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = "".join(c for c in master if c.isdigit()) or str(os.cpu_count() or 8)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", cores)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

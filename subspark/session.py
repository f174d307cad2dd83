"""Session defaults. Library code never builds a session by itself."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; shuffle partitions follow the cores."""
    cores = os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

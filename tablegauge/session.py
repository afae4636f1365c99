"""A local Spark session for tests and benchmarks. On a cluster the session is the cluster's."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablegauge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # A full profile compiles more generated classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "5000")
        .getOrCreate()
    )

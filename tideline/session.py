"""Session settings that the library's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, set SETTINGS in its own configuration."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tideline").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    return builder.config(map=SETTINGS).getOrCreate()

"""Session settings shared by tests, the bench and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any scale; sizes of partitions are left to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', 8)}]").appName("tamis")
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

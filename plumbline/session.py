"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew handling, and a fixed time zone. Works on any master."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python line of every column expression takes longer than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def local_session(
    cores: int | str | None = None, memory: str = "16g", options: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and measurements."""
    cores = cores or os.environ.get("BENCH_CPUS") or 8
    builder = configure(SparkSession.builder.master(f"local[{cores}]").appName("plumbline"))
    for key, value in (options or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

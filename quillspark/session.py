"""One place that builds a session for tests, benchmarks and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | None = None, app: str = "quillspark") -> SparkSession:
    """A local session; a cluster passes its own settings to spark-submit instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUILLSPARK_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

"""Spark sessions as the library expects them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "fleetward", cores: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(8, cores)))
        .config("spark.driver.memory", os.environ.get("FLEETWARD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "textloom", **conf: str) -> SparkSession:
    """The running session, or a local one: adaptive execution, UTC, a partition per core."""
    cores = os.environ.get("BENCH_CPUS", "*")
    count = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": str(count),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

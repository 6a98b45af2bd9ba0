"""Session builder for tests, the bench and command-line use."""

import os

from pyspark.sql import SparkSession


def session(app: str = "recordloom", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries are tested with.

    On a cluster the caller brings its own session; no operator needs a setting from here.
    """
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

"""Session used by the tests and the benchmark; on a cluster the caller brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "tillbook") -> SparkSession:
    """A local session: shuffle partitions follow the cores, AQE does the rest."""
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # A shuffled partition this small is hashed instead of sorted; a larger one still sorts.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        # Parquet is compressed: count a file as four times its size before broadcasting it.
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )

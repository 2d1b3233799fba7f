"""Session settings the plans are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """Session with runtime re-planning on; master and sizes stay the cluster's own.

    ``shuffle_partitions`` is the upper limit that coalescing starts from: leave it
    to the cluster, or set it to a few times the cores. ``driver_memory`` matters in
    local mode, where the driver is the only executor.
    """
    builder = (
        SparkSession.builder.appName("mound")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()

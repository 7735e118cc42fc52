"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot key is split at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # tasks that call the labeller must not be started twice
    "spark.speculation": "false",
}


def session(
    master: str | None = None, shuffle_partitions: int | None = None, input_gb: float | None = None, **extra: str
) -> SparkSession:
    """`input_gb` sizes shuffles at about 128 MB a partition; adaptive execution merges small ones."""
    if input_gb and not shuffle_partitions:
        shuffle_partitions = max(200, int(input_gb * 8))
    builder = SparkSession.builder.appName("faultline")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

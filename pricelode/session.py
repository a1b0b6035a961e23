"""Spark session with the settings the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session in UTC with adaptive execution; ``shuffle_partitions`` is for local runs, a cluster sets its own."""
    return (
        SparkSession.builder.master(master)
        .appName("pricelode")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

"""Spark sessions for local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine; on a cluster, pass the cluster's own session to the library instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

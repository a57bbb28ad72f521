"""A session with the settings that this library counts on; on a cluster, settings of its own come first."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; partitions only for local runs."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if master:
        conf |= {"spark.master": master, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return SparkSession.builder.config(map=conf | more).getOrCreate()

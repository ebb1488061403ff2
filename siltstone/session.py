"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and shuffle partitions sized to the cluster; ``conf`` overrides."""
    builder = SparkSession.builder.appName("siltstone")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | conf).getOrCreate()

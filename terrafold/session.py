"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "terrafold", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and ANSI mode left on (bad casts are asked for by ``try_cast``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "fpsample", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; keywords are settings with underscores for dots."""
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

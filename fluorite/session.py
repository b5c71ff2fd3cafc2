"""Session factory with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "fluorite", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI SQL, adaptive execution and UTC; conf keys use _ for dots' place only if given as spark_x_y."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

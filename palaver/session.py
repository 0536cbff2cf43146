"""Session defaults for local use and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    """A ``local[cpus]`` session with as many shuffle partitions as threads."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("palaver")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

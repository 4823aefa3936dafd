"""A session with the settings that the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "filigree", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session: UTC, ANSI, adaptive execution. On a cluster, bring your own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()

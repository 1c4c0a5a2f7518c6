"""The session that the library, its tests and its benchmark use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution. On a cluster, jobs take the session that the submitter made: no
    operator calls this, and all read spark.sql.shuffle.partitions and spark.checkpoint.dir from the session they are given."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{n}]").config(map=settings).getOrCreate()

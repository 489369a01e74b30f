"""Session helper for tests, the bench and local runs.

On a cluster, pass the cluster's own session; nothing here is required.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ruleframe",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session; input is split into at least two tasks per core so one
    slow task does not hold a stage (cluster sessions keep their own sizing).

    ``event_log_dir`` turns on Spark's event log there, for stage and task
    times without the web UI (which stays off).
    """
    ncores = int(cores) if str(cores).isdigit() else (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", str(2 * ncores))
        .config("spark.driver.memory", os.environ.get("RULEFRAME_DRIVER_MEMORY", "16g"))
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

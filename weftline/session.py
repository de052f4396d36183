"""Session defaults. On a cluster the submitter's settings win; these only fill gaps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches. Sets a checkpoint folder only where none is named."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        own = tempfile.mkdtemp(prefix="weftline-")  # local runs and tests only: a cluster names its shared folder
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))

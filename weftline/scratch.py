"""Written intermediate tables: the lineage cut of every iterative operator.

A table written to the shared folder survives the loss of any executor, is compressed, and
is read back with column pruning; that is why it is preferred to ``checkpoint()`` here.
The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is
unset (tests, local runs) a temporary folder is made once per session.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
    return _LOCAL[app]


class Scratch:
    """Tables of one operator call under one folder; dropped singly or at exit."""

    def __init__(self, spark: SparkSession, name: str = "op"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._gone)

    def write(self, df: DataFrame, tag: str = "t") -> tuple[DataFrame, str]:
        """Write ``df`` and read it back; returns the table and its path."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, tag: str = "t") -> DataFrame:
        return self.write(df, tag)[0]

    def union(self, paths: list[str], schema) -> DataFrame:
        """Tables of one schema written one after the other, read as one."""
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, path: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _gone(self) -> None:
        try:
            self.drop(self.root)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass

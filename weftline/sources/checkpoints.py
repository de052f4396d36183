"""Stored stages: parquet tables beside a small record of the options they were made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, **made_with) -> None:
    """Write a stage and the options that a later load must agree with."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = [(k, str(v)) for k, v in sorted(made_with.items())]
    df.sparkSession.createDataFrame(rows, "option string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/made_with")


def load(spark: SparkSession, path: str, **must_match) -> DataFrame:
    """A stored stage; raises if an option given here was another when it was written."""
    was = {r["option"]: r["value"] for r in spark.read.parquet(f"{path}/made_with").collect()}
    for k, v in must_match.items():
        if was.get(k) != str(v):
            raise ValueError(f"{path} was made with {k}={was.get(k)}, not {v}")
    return spark.read.parquet(f"{path}/data")


def lookup(keys: DataFrame, counts: DataFrame, saturated: int) -> DataFrame:
    """Counts of keys from a stored count table; a saturated count reads -1, an absent one 0."""
    c = F.coalesce(F.col("cnt"), F.lit(0))
    return keys.join(counts, "code", "left").withColumn("cnt", F.when(c >= saturated, -1).otherwise(c))

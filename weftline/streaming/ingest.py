"""Structured Streaming counterparts: continuous k-mer counts, windowed arrivals and late-data handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import kmer_counts


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A folder of parquet files as a stream, a bounded number of files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def arrivals(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "3 hours") -> DataFrame:
    """Rows and distinct-ish keys per event-time window, late rows accepted for ``late`` by watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(events: DataFrame, keys: list[str], at: str, late: str = "3 hours") -> DataFrame:
    """Each record once: repeats within the watermark are dropped from bounded state."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def count_into(reads: DataFrame, k: int, table_path: str, checkpoint: str) -> StreamingQuery:
    """k-mer counts of every micro-batch appended under its batch number; a rerun batch overwrites itself.

    Totals are ``groupBy("code").sum("cnt")`` over the table; see ``totals``.
    """

    def put(batch: DataFrame, number: int) -> None:
        kmer_counts(batch, k, saturate=1 << 60).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, table_path: str, saturate: int) -> DataFrame:
    return spark.read.parquet(table_path).groupBy("code").agg(F.least(F.sum("cnt"), F.lit(saturate)).alias("cnt"))

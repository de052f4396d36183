"""FASTA and FASTQ as a Spark data source: ``spark.read.format("fastx").load(path)``.

Plain files are cut into byte ranges that resynchronise at the next record, gzip files are
read whole, one task each. Batches leave as Arrow. Options: ``splitBytes`` (default 64 MB).
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.seq import quality_sum

SCHEMA = "name string, comment string, seq string, qual string, file string, ord long"
ROWS = 2048


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


def _lines(f, start: int) -> Iterator[tuple[int, bytes]]:
    at = start
    for line in f:
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, str, str, str | None, int]]:
    """(name, comment, seq, qual, byte offset) of every record that starts in [start, end)."""
    packed = path.endswith(".gz")
    size = 1 << 62 if packed else os.path.getsize(path)
    end = size if end is None else end
    with gzip.open(path, "rb") if packed else open(path, "rb") as f:
        first = f.read(1)
        fastq = first == b"@"
        at = start
        f.seek(max(0, start - 1))
        if start:
            at = start - 1 + len(f.readline())  # to the next line
        if fastq and start:
            at = _sync_fastq(f, at)
            f.seek(at)
        it = _lines(f, at)
        pending: tuple[int, bytes] | None = None
        while True:
            pos, head = pending or next(it, (None, b""))
            pending = None
            while head is not None and pos is not None and not head.startswith(b"@" if fastq else b">"):
                pos, head = next(it, (None, b""))
            if pos is None or pos >= end:
                return
            name, _, comment = head[1:].decode("ascii", "replace").partition(" ")
            if fastq:
                seq = next(it, (0, b""))[1]
                next(it, None)
                qual = next(it, (0, b""))[1]
                yield name, comment, seq.decode("ascii", "replace"), qual.decode("latin1"), pos
            else:
                parts = []
                for p, line in it:
                    if line.startswith(b">"):
                        pending = (p, line)
                        break
                    parts.append(line)
                yield name, comment, b"".join(parts).decode("ascii", "replace"), None, pos
                if pending is None:
                    return


def _sync_fastq(f, at: int) -> int:
    """Offset of the next four-line record: a line with @ whose second line after begins with +."""
    window: list[tuple[int, bytes]] = []
    for pos, line in _lines(f, at):
        window.append((pos, line))
        if len(window) >= 4:
            a, _, c, _ = window[-4:]
            if a[1].startswith(b"@") and c[1].startswith(b"+") and len(window[-3][1]) == len(window[-1][1]):
                return a[0]
    return at + sum(len(x) + 1 for _, x in window)


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def partitions(self):
        files = sorted(x for p in self.path.split(",") for x in (glob.glob(os.path.join(p, "*")) if os.path.isdir(p) else glob.glob(p)) if os.path.isfile(x))
        if not files:
            raise FileNotFoundError(self.path)
        out = []
        for f in files:
            if f.endswith(".gz"):
                out.append(Piece(f, 0, 1 << 62))
                continue
            size = os.path.getsize(f)
            out += [Piece(f, s, min(size, s + self.split)) for s in range(0, size, self.split)]
        return out

    def read(self, partition):
        rows = []
        for name, comment, seq, qual, at in records(partition.path, partition.start, partition.end):
            rows.append((name, comment, seq, qual, partition.path, at))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.string()] * 5 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["name", "comment", "seq", "qual", "file", "ord"])


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(dict(self.options))


def read_fastx(spark: SparkSession, path: str, adapter: int = 0, min_len: int = 0, min_mean_quality: int | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """rid, name, seq, qual, len: records with ``adapter`` letters cut off both ends, short and poor ones dropped.

    rid is dense and follows file and offset: counts per file and range are added up on the
    driver (one number a range), not the records.
    """
    spark.dataSource.register(FastxSource)
    t = spark.read.format("fastx").option("splitBytes", str(split_bytes)).load(path)
    if adapter:
        n = F.greatest(F.lit(0), F.length("seq") - 2 * adapter)
        t = t.withColumn("qual", F.substring(F.col("qual"), F.lit(adapter + 1), n)).withColumn("seq", F.substring(F.col("seq"), F.lit(adapter + 1), n))
    t = t.where(F.length("seq") > 0)
    if min_len:
        t = t.where(F.length("seq") >= min_len)
    if min_mean_quality is not None:
        t = t.where(F.col("qual").isNull() | (quality_sum(F.col("qual")) >= F.length("qual") * min_mean_quality))
    return dense_ids(t).select("rid", "name", "seq", "qual", F.length("seq").alias("len"))


def dense_ids(t: DataFrame) -> DataFrame:
    """Adds rid 0, 1, ... in order of (file, ord), by ranks within (file, range of offsets) plus offsets of the ranges."""
    from pyspark.sql import Window

    t = t.withColumn("_range", F.floor(F.col("ord") / (64 << 20)))
    n = t.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file", "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_before", before).drop("_n")  # one row a 64 MB range
    k = F.row_number().over(Window.partitionBy("file", "_range").orderBy("ord"))
    return t.withColumn("_k", k).join(n, ["file", "_range"]).withColumn("rid", (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_k", "_before", "_range")


def append_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two read tables under one id space: ids of the second are shifted past the largest of the first."""
    m = first.agg((F.coalesce(F.max("rid"), F.lit(-1)) + 1).alias("_m"))
    return first.unionByName(second.join(F.broadcast(m)).withColumn("rid", F.col("rid") + F.col("_m")).drop("_m"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two mates by ordinal; both sides must have the same number of records."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"mate files differ: {a} and {b} records")
    r = right.select("rid", F.col("name").alias("name2"), F.col("seq").alias("seq2"))
    return left.select("rid", F.col("name").alias("name1"), F.col("seq").alias("seq1")).join(r, "rid")

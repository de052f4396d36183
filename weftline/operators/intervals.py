"""Interval joins and sweeps as equi-joins on position buckets and one-pass window sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 256


def with_buckets(df: DataFrame, start: str, end: str, width: int = BUCKET) -> DataFrame:
    """One row per position bucket that the half-open interval touches."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, width: int = BUCKET) -> DataFrame:
    """Pairs of intervals with the same key that overlap, once each.

    A pair meets in several buckets; it is kept in the one where the later of the two starts
    lies, so no distinct is needed. Empty intervals overlap nothing.
    """
    a, b = with_buckets(left, ls, le, width), with_buckets(right, rs, re, width)
    j = a.join(b, [key, "_bucket"])
    hit = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    return j.where(hit & (F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bucket"))).drop("_bucket")


def point_join(points: DataFrame, spans: DataFrame, key: str, pos: str, start: str, end: str, width: int = BUCKET) -> DataFrame:
    """Points with the half-open intervals of the same key that hold them."""
    p = points.withColumn("_bucket", F.floor(F.col(pos) / width))
    j = p.join(with_buckets(spans, start, end, width), [key, "_bucket"])
    return j.where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_bucket")


def depth_sweep(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, s, e, depth: maximal stretches between neighbouring interval ends, with how many intervals cover them.

    Starts and ends at one position are summed before the running sum, so its rows are unique
    positions. Stretches of depth 0 between intervals are included; empty intervals are not.
    """
    t = spans.where(F.col(start) < F.col(end))
    ev = t.select(key, F.col(start).alias("pos"), F.lit(1).alias("d")).unionByName(t.select(key, F.col(end).alias("pos"), F.lit(-1).alias("d")))
    ev = ev.groupBy(key, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("pos")
    out = ev.select(key, F.col("pos").alias("s"), F.lead("pos").over(w).alias("e"), F.sum("d").over(w).alias("depth"))
    return out.where("e is not null")


def union_length(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered: total length of the union of the intervals of a key."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = spans.withColumn("_new", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start)))))
    return t.groupBy(key).agg(F.sum("_new").alias("covered"))

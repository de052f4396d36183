"""Views over the sequence tables that the core queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kmers import passing


class Registry:
    """Queries of one module with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df, *by: str):
    """Even partitions (of the columns ``by``) in front of a kernel, whose cost lies in rows and not in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def reads(spark: SparkSession, d: str, only: np.ndarray | None = None) -> DataFrame:
    """One row per record: rid, name, seq (upper case), qual, len. Deliveries of a record are merged.

    ``only``: a ``code_filter`` of rids; records that it rules out are left out, and of the others there are rid, seq and len alone.
    """
    t = table(spark, d, "kseq_reads").where("rid is not null and seq is not null and seq <> ''")
    if only is not None:
        t = passing(t.select(F.col("rid").cast("long").alias("rid"), F.upper("seq").alias("seq")), "rid", only)
        return spread(t, "rid").groupBy("rid").agg(F.max("seq").alias("seq")).withColumn("len", F.length("seq"))
    t = t.groupBy("rid").agg(F.max("read_name").alias("name"), F.max(F.upper("seq")).alias("seq"), F.max("qual").alias("qual"))
    return t.withColumn("len", F.length("seq"))


READS = """reads AS (SELECT rid, max(read_name) AS name, max(upper(seq)) AS seq, max(qual) AS qual, length(max(upper(seq)))::INTEGER AS len
FROM kseq_reads WHERE rid IS NOT NULL AND seq IS NOT NULL AND seq <> '' GROUP BY rid)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """rid, run, place: the run that a record was first listed for, and the place of that run by number of records (1 the largest; ties by name)."""
    t = table(spark, d, "kseq_reads").where("rid is not null and run_id is not null").groupBy("rid").agg(F.min("run_id").alias("run"))
    n = t.groupBy("run").agg(F.count(F.lit(1)).alias("n"))  # one row a run
    return t.join(n.select("run", F.row_number().over(Window.orderBy(F.desc("n"), "run")).alias("place")), "run").select("rid", "run", "place")


RUNS = """rec_run AS (SELECT rid, min(run_id) AS run FROM kseq_reads WHERE rid IS NOT NULL AND run_id IS NOT NULL GROUP BY rid),
runs AS (SELECT rid, run, place::INTEGER AS place FROM rec_run JOIN (SELECT run, row_number() OVER (ORDER BY count(*) DESC, run) AS place FROM rec_run GROUP BY run) USING (run))"""


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairwise matches with both lengths: qn,ql,qs,qe,tn,tl,ts,te,rev,ml,bl; half-open, forward strand."""
    p = table(spark, d, "paf").where("x_id is not null and y_id is not null")
    rev = (F.coalesce("x_pos_strand", F.lit(0)) != F.coalesce("y_pos_strand", F.lit(0))).cast("int")
    p = p.select(F.col("x_id").alias("qn"), F.col("x_pos_s").alias("qs"), F.col("x_pos_e").alias("qe"), F.col("y_id").alias("tn"), F.col("y_pos_s").alias("ts"), F.col("y_pos_e").alias("te"), rev.alias("rev"), F.col("match_len").alias("ml"), F.col("total_len").alias("bl")).distinct()
    r = reads(spark, d).select("rid", F.col("len").cast("long").alias("len"))
    p = p.join(r.select(F.col("rid").alias("qn"), F.col("len").alias("ql")), "qn").join(r.select(F.col("rid").alias("tn"), F.col("len").alias("tl")), "tn")
    return p.select("qn", "ql", "qs", "qe", "tn", "tl", "ts", "te", "rev", "ml", "bl")


OVERLAPS = (
    READS
    + """, ovl AS (SELECT p.qn, q.len::BIGINT AS ql, p.qs, p.qe, p.tn, t.len::BIGINT AS tl, p.ts, p.te, p.rev, p.ml, p.bl FROM (
SELECT DISTINCT x_id AS qn, x_pos_s AS qs, x_pos_e AS qe, y_id AS tn, y_pos_s AS ts, y_pos_e AS te, (coalesce(x_pos_strand, 0) <> coalesce(y_pos_strand, 0))::INTEGER AS rev, match_len AS ml, total_len AS bl
FROM paf WHERE x_id IS NOT NULL AND y_id IS NOT NULL) p JOIN reads q ON q.rid = p.qn JOIN reads t ON t.rid = p.tn)"""
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected weighted links between records: u < v, w = best match length."""
    o = overlaps(spark, d).where("qn <> tn")
    return o.groupBy(F.least("qn", "tn").alias("u"), F.greatest("qn", "tn").alias("v")).agg(F.max("ml").alias("w"), F.count(F.lit(1)).alias("n"))


EDGES = OVERLAPS + ", edges AS (SELECT least(qn, tn) AS u, greatest(qn, tn) AS v, max(ml) AS w, count(*)::BIGINT AS n FROM ovl WHERE qn <> tn GROUP BY ALL)"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Decoded seed hits: qid, tid, rev, qoff, toff, cnt (deliveries merged)."""
    a = table(spark, d, "anchors").where("rid is not null and srt is not null")
    return a.select(
        F.col("rid").alias("qid"), F.shiftrightunsigned("srt", 33).alias("tid"), F.expr("cast(shiftrightunsigned(srt, 32) & 1 as int)").alias("rev"),
        F.col("self_off").cast("long").alias("qoff"), F.expr("srt & 4294967295").alias("toff"), "cnt",
    ).distinct()


SEEDS = """seeds AS (SELECT DISTINCT rid AS qid, srt >> 33 AS tid, ((srt >> 32) & 1)::INTEGER AS rev, self_off::BIGINT AS qoff, srt & 4294967295 AS toff, cnt
FROM anchors WHERE rid IS NOT NULL AND srt IS NOT NULL)"""

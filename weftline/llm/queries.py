"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import components, count_sketch, leakage, packing, residue, rlz_spans, seen_filter, term_bitmaps


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rlz_spans.shared_spans(_t(spark, d, "kseq_reads"))


def p1_hot_found(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with so low a limit that the way of the hot minimizers is taken at any size."""
    return rlz_spans.shared_spans(_t(spark, d, "kseq_reads"), hot_pieces=20)


def p1_long_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans of 200 letters or more."""
    return rlz_spans.shared_spans(_t(spark, d, "kseq_reads"), min_len=200)


def p1_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return rlz_spans.shared_share(_t(spark, d, "kseq_reads")).select("x_id", "n_letters", "shared_letters", F.round("shared_share", 6).alias("shared_share"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_bitmaps.term_frequencies({"x": (_t(spark, d, "minimizers"), "x", "rid"), "cnt": (_t(spark, d, "anchors"), "cnt", "rid")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark is not null").select("field_name", "val", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_filter.seen_before(_t(spark, d, "minimizers"), "x", "mz_id")[0]


def p4_error(spark: SparkSession, d: str) -> DataFrame:
    return seen_filter.error_report(_t(spark, d, "minimizers"), "x", "mz_id")


def p4_stored(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p4_found by two batches: the second is answered from the stored filters of the first, whose keys it never reads."""
    mz = _t(spark, d, "minimizers")
    cut = mz.agg((F.min("mz_id") + F.expr("(max(mz_id) - min(mz_id)) * 2 div 3"))).first()[0] or 0
    store = seen_filter.Store(spark, Scratch(spark, "filters").root)
    first = seen_filter.seen_in_store(mz.where(F.col("mz_id") < cut), "x", "mz_id", store)[0]
    return first.unionByName(seen_filter.seen_in_store(mz.where(F.col("mz_id") >= cut), "x", "mz_id", store)[0])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.link_groups(_t(spark, d, "paf"), "x_id", "y_id")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    return count_sketch.top_values(_t(spark, d, "minimizers"), "x")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("val", "n_rows", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select(F.col("val").alias("x"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_summary(_t(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_recall(spark: SparkSession, d: str) -> DataFrame:
    return leakage.recall(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_kinds(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_hot_found, p1_long_found, p1_shared_share, p2_found, p2_terms, p4_found, p4_error, p4_stored, p5_found, p6_found, p6_ranked, p6_top, p7_pack, p7_summary, p8_found, p8_recall, p9_found, p9_kinds)}

_SPANS_OF = """
WITH w AS (
  SELECT DISTINCT rid, s, substr(u, s + 1, @N@) AS win
  FROM (SELECT rid, upper(seq) AS u, unnest(range(0, greatest(length(seq) - @N@ + 1, 0))) AS s FROM kseq_reads WHERE rid IS NOT NULL AND seq IS NOT NULL)
  WHERE regexp_full_match(substr(u, s + 1, @N@), '[ACGT]{@N@}')
), shared AS (
  SELECT win FROM w GROUP BY win HAVING count(DISTINCT rid) > 1
), hit AS (
  SELECT DISTINCT rid, s FROM w SEMI JOIN shared USING (win)
), marked AS (
  SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + @N@ THEN 0 ELSE 1 END AS new FROM hit
), island AS (
  SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS g FROM marked
), spans AS (
  SELECT rid AS x_id, min(s)::BIGINT AS x_pos_s, (max(s) + @N@)::BIGINT AS x_pos_e FROM island GROUP BY rid, g
)
"""

_SPANS = _SPANS_OF.replace("@N@", "100")

_TERMS = """
WITH t AS (SELECT 'x' AS field_name, x AS val, rid FROM minimizers UNION ALL SELECT 'cnt', cnt, rid FROM anchors),
f AS (SELECT field_name, val, count(*)::BIGINT AS n_rows, count(DISTINCT rid)::BIGINT AS n_records FROM t WHERE val IS NOT NULL GROUP BY ALL)
SELECT field_name, val, n_rows, n_records, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records > 20 THEN 'common' END AS mark FROM f
"""

SQL = {
    "p1_found": _SPANS + "SELECT * FROM spans",
    "p1_hot_found": _SPANS + "SELECT * FROM spans",
    "p1_long_found": _SPANS_OF.replace("@N@", "200") + "SELECT * FROM spans",
    "p1_shared_share": _SPANS + """
SELECT r.x_id, r.n_letters, coalesce(g.n, 0)::BIGINT AS shared_letters, round(CASE WHEN r.n_letters > 0 THEN coalesce(g.n, 0) / r.n_letters ELSE 0 END, 6) AS shared_share
FROM (SELECT rid AS x_id, coalesce(max(length(seq)), 0)::BIGINT AS n_letters FROM kseq_reads WHERE rid IS NOT NULL GROUP BY rid) r
LEFT JOIN (SELECT x_id, sum(x_pos_e - x_pos_s) AS n FROM spans GROUP BY x_id) g USING (x_id)""",
    "p2_found": f"SELECT field_name, val, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p2_terms": _TERMS,
    "p4_stored": "SELECT mz_id FROM (SELECT mz_id, x, min(mz_id) OVER (PARTITION BY x) AS f FROM minimizers WHERE x IS NOT NULL) WHERE mz_id > f",
    "p4_found": "SELECT mz_id FROM (SELECT mz_id, x, min(mz_id) OVER (PARTITION BY x) AS f FROM minimizers WHERE x IS NOT NULL) WHERE mz_id > f",
    "p5_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT x_id AS u, y_id AS v FROM paf WHERE x_id <> y_id UNION SELECT DISTINCT y_id, x_id FROM paf WHERE x_id <> y_id
), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT least(min(v), u) AS group_id, u AS rid FROM r GROUP BY u""",
    "p6_ranked": "SELECT x AS val, count(*)::BIGINT AS n_rows, (row_number() OVER (ORDER BY count(*) DESC, x))::INTEGER AS rank FROM minimizers WHERE x IS NOT NULL GROUP BY x ORDER BY rank LIMIT 10",
    "p6_found": "SELECT x FROM minimizers WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 10",
}

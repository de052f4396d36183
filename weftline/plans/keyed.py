"""Problem 3: per-key results without imbalance, over the minimizer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import tree_agg


def _summary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mz = spark.read.parquet(f"{d}/minimizers.parquet")
    return mz, tree_agg.tree_summary(mz, "x", "rid", "pos")


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)[1]


def p3_deep(spark: SparkSession, d: str) -> DataFrame:
    """p3_keys with so small leaves that hot keys go through several rounds at any size."""
    mz = spark.read.parquet(f"{d}/minimizers.parquet")
    return tree_agg.tree_summary(mz, "x", "rid", "pos", fan_in=4, chunk_states=64)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    mz, summary = _summary(spark, d)
    return tree_agg.dominant_keys(summary, mz.count())


_SIDE = """SELECT '{k}' AS key_field, {k} AS key_value, count(*)::BIGINT AS n_rows, count(DISTINCT {p})::BIGINT AS n_partners,
min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM minimizers WHERE {k} IS NOT NULL GROUP BY {k}"""
_BOTH = _SIDE.format(k="x", p="rid") + " UNION ALL " + _SIDE.format(k="rid", p="x")

QUERIES = {"p3_found": p3_found, "p3_keys": p3_keys, "p3_deep": p3_deep}
SQL = {
    "p3_keys": _BOTH,
    "p3_deep": _BOTH,
    "p3_found": f"SELECT key_field, key_value FROM ({_BOTH}) WHERE n_rows * 50 >= (SELECT count(*) FROM minimizers)",
}

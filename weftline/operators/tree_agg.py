"""Per-key summaries by multi-level tree aggregation.

A handful of keys may hold most rows. Level 0 combines fixed-size input chunks where they
are read (one input split per task, partial hash aggregation), so a repeated (key, partner)
pair leaves a chunk as one state however hot it is. A key that the chunk sketches show to be
heavy then gets ``fan_in ** depth`` leaf nodes, chosen by the hash of the partner; its
states merge through ``depth`` rounds, ``fan_in`` nodes to one each time, and no reducer
receives more than a leaf's share of them. A light key has one leaf, which is its root, and
takes no part in the later rounds. Since one partner goes to one leaf only, distinct
partners add up exactly.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

FAN_IN = 16
#: States that one leaf node should hold.
CHUNK_STATES = 4_096
#: Values that a chunk's frequency sketch tracks; the error is rows / TRACKED at most.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, chunk_states: int = CHUNK_STATES, tracked: int = TRACKED) -> list[tuple]:
    """(key, estimated rows) of every key with more than ``chunk_states`` rows and a share over 1/``tracked``.

    One pass with a frequent-items sketch of bounded size; keys below that share need no
    tree, as their rows fit one leaf at any size the engine splits by (they are at most
    ``1/tracked`` of a table, and AQE sizes reducers by bytes).
    """
    n = max(tracked // 4, 1)
    got = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {n}, {tracked})").alias("t")).first()
    return [(r["item"], r["count"]) for r in (got["t"] or []) if r["count"] > chunk_states]


def pair_states(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """One state per distinct (a, b): rows, first and last ``order``. Names are fixed, so other columns can't clash."""
    base = df.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(order).cast("long").alias("o"))
    return base.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi"))


def _merge(states: DataFrame, node) -> DataFrame:
    return states.groupBy("side", "key", node.alias("node")).agg(
        F.sum("n").alias("n"), F.sum("partners").alias("partners"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("depth").alias("depth")
    )


def tree_summary(df: DataFrame, a: str, b: str, order: str, fan_in: int = FAN_IN, chunk_states: int = CHUNK_STATES) -> DataFrame:
    """Rows, distinct partners, first and last position per value of ``a`` and per value of ``b``.

    Output: key_field, key_value, n_rows, n_partners, first_pos, last_pos. The partners of a
    value of ``a`` are the distinct values of ``b`` and the other way round. Rows with a null
    key have no result; a null partner counts as a row but not as a partner; a null position
    is passed over (null if all are). Repeated rows count each time. An empty table gives no rows.
    """
    # written once: both sides read it
    pairs = Scratch(df.sparkSession, "pairs").table(pair_states(df, a, b, order), "pairs")
    heavy = {0: heavy_keys(df.select(F.col(a).cast("long").alias(a)), a, chunk_states), 1: heavy_keys(df.select(F.col(b).cast("long").alias(b)), b, chunk_states)}
    depth = {(s, k): max(1, math.ceil(math.log(n / chunk_states, fan_in) + 1e-9)) for s, ks in heavy.items() for k, n in ks}
    levels = max(depth.values(), default=0)

    def side(s: int, key: str, partner: str) -> DataFrame:
        # a literal map of the heavy keys: at most TRACKED/4 entries
        d = F.lit(0)
        for k_depth in range(1, levels + 1):
            at = [k for (t, k), v in depth.items() if t == s and v == k_depth]
            d = F.when(F.col(key).isin(at), F.lit(k_depth)).otherwise(d) if at else d
        return pairs.where(F.col(key).isNotNull()).select(
            F.lit(s).alias("side"), F.col(key).alias("key"), F.col(partner).alias("p"), "n", "lo", "hi", d.cast("int").alias("depth")
        )

    both = side(0, "a", "b").unionByName(side(1, "b", "a"))
    leaf = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("p"), F.pow(F.lit(fan_in), F.col("depth")).cast("long")).cast("int"))
    states = both.select("side", "key", leaf.alias("node"), F.col("p").isNotNull().cast("long").alias("partners"), "n", "lo", "hi", "depth")
    out = _merge(states, F.col("node"))
    if levels:
        # depth is an aggregate here, so the filters stay above the shuffle and both branches reuse it
        done, open_ = out.where("depth = 0"), out.where("depth > 0")
        for _ in range(levels):
            open_ = _merge(open_, F.floor(F.col("node") / fan_in).cast("int"))
        out = done.unionByName(open_)
    return out.select(
        F.when(F.col("side") == 0, F.lit(a)).otherwise(F.lit(b)).alias("key_field"), F.col("key").alias("key_value"),
        F.col("n").alias("n_rows"), F.col("partners").alias("n_partners"), F.col("lo").alias("first_pos"), F.col("hi").alias("last_pos"),
    )


def dominant_keys(summary: DataFrame, total_rows: int, share: float = 0.02) -> DataFrame:
    """Keys of ``tree_summary`` holding at least ``share`` of ``total_rows``."""
    least = max(1, math.ceil(Fraction(str(share)) * total_rows))
    return summary.where(F.col("n_rows") >= F.lit(least)).select("key_field", "key_value")

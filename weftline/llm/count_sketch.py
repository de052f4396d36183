"""Problem 6: heavy hitters in bounded memory by a hierarchical count-sketch.

A value is mixed by a bijection of 64 bits; level l of the hierarchy holds the counts of the
top 8*(l+1) bits. The first two levels are exact tables of 256 and 65,536 cells, each deeper
level a count-sketch of ``depth`` rows of ``width`` cells with signed hashes. Every task folds
its rows into one such structure (about 4 MB whatever the input), the structures add up
block-wise in rounds of fan-in, and the sum descends from heavy prefixes to heavy values on
the driver. A second scan counts the surviving candidates exactly, and the descent says
whether what it left out could hold one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.bits import mix, unmix

LEVELS = 8
BLOCK = 4096


class Hierarchy:
    """Exact tables for the first 16 bits, count-sketches for the prefixes below."""

    def __init__(self, depth: int = 5, width_bits: int = 14):
        self.depth, self.bits = depth, width_bits
        self.width = 1 << width_bits
        self.head = 256 + 65536
        self.cells = np.zeros(self.head + (LEVELS - 2) * depth * self.width, np.int64)

    def _slot(self, level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = mix(prefix * np.uint64(2 * self.depth * LEVELS + 1) + np.uint64(level * self.depth + row + 1))
        cell = (g >> np.uint64(64 - self.bits)).astype(np.int64)
        sign = 1 - 2 * (g & np.uint64(1)).astype(np.int64)
        return self.head + ((level - 2) * self.depth + row) * self.width + cell, sign

    def add(self, values: np.ndarray) -> None:
        v, n = np.unique(values, return_counts=True)
        h = mix(v)
        np.add.at(self.cells, (h >> np.uint64(56)).astype(np.int64), n)
        np.add.at(self.cells, 256 + (h >> np.uint64(48)).astype(np.int64), n)
        for level in range(2, LEVELS):
            p = h >> np.uint64(64 - 8 * (level + 1))
            for row in range(self.depth):
                at, sign = self._slot(level, row, p)
                np.add.at(self.cells, at, sign * n)

    def estimate(self, level: int, prefix: np.ndarray) -> np.ndarray:
        if level < 2:
            return self.cells[(0, 256)[level] + prefix.astype(np.int64)]
        e = []
        for row in range(self.depth):
            at, sign = self._slot(level, row, prefix)
            e.append(self.cells[at] * sign)
        return np.median(np.stack(e), axis=0).astype(np.int64)

    def error(self, level: int) -> float:
        """Three standard errors of an estimate: a row of the sketch spreads the second moment over its cells."""
        if level < 2:
            return 0.0
        at = self.head + (level - 2) * self.depth * self.width
        rows = self.cells[at : at + self.depth * self.width].astype(np.float64).reshape(self.depth, self.width)
        # cells of a few heavy values don't add to the error of others: the median row over all but the 1 % largest cells
        tail = np.sort(rows**2, axis=1)[:, : -max(1, self.width // 100)]
        return 3 * float(np.sqrt(np.median(tail.mean(axis=1)))) / np.sqrt(self.depth) * 1.26

    def descend(self, keep: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The ``keep`` heaviest prefixes of each level, down to whole values and their estimates, and the most rows that a prefix left out can hold."""
        p, cut = np.arange(256, dtype=np.uint64), 0.0
        for level in range(LEVELS):
            if level:
                p = ((p[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None, :]).ravel()
            e = self.estimate(level, p)
            order = np.argsort(-e, kind="stable")
            if len(order) > keep:
                cut = max(cut, float(e[order[keep]]) + self.error(level))
            order = order[:keep]
            order = order[e[order] > 0]
            p, e = p[order], e[order]
        return unmix(p).astype(np.int64), e, cut


#: Partial sketches that one merge task adds up; with BLOCK cells of 8 bytes a group reads FAN_IN * 32 KB.
FAN_IN = 64
#: Tasks that fold input, per core of the cluster: they bound the partial sketches whatever the number of input splits.
FOLDS_PER_CORE = 4


def fold_partials(values: DataFrame, depth: int, width_bits: int) -> DataFrame:
    """block, node, cells: the non-empty blocks of one sketch per partition of the single column ``v``."""

    def fold(batches):
        from pyspark import TaskContext

        h = Hierarchy(depth, width_bits)
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= 1 << 18:
                h.add(np.concatenate(held))
                held, size = [], 0
        if held:
            h.add(np.concatenate(held))
        me = TaskContext.get().partitionId()
        for i in range(0, len(h.cells), BLOCK):
            c = h.cells[i : i + BLOCK]
            if c.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "node": pa.array([me], pa.int32()), "cells": pa.array([c.tobytes()], pa.binary())})

    return values.mapInArrow(fold, "block int, node int, cells binary")


def merge_round(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One round of the merge: ``fan_in`` nodes of a block become one."""

    def add_up(t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for c in t.column("cells"):
            x = np.frombuffer(c.as_py(), np.int64)
            total[: len(x)] += x
        return pa.table({"block": t.column("block")[:1], "node": pa.array([t.column("to")[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    keyed = parts.withColumn("to", F.floor(F.col("node") / fan_in).cast("int"))
    return keyed.groupBy("block", "to").applyInArrow(add_up, "block int, node int, cells binary")


def merge_rounds(parts: DataFrame, n_parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rounds of fan-in until one node a block is left; ``n_parts`` is over every node number."""
    while n_parts > 1:
        parts = merge_round(parts, fan_in)
        n_parts = -(-n_parts // fan_in)
    return parts


def sketch(df: DataFrame, col: str, depth: int = 5, width_bits: int = 14) -> Hierarchy:
    """The merged sketch of one column. Its size is fixed, so it may be gathered.

    A task folds several input splits, so that partials are bounded by the cores and not by the
    input; they meet in rounds of FAN_IN, no task reads more than FAN_IN blocks for a group.
    """
    x = df.select(F.col(col).cast("long").alias("v")).where("v is not null")
    folds = max(1, FOLDS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    parts = merge_rounds(fold_partials(x.coalesce(folds), depth, width_bits), folds)
    h = Hierarchy(depth, width_bits)
    for r in parts.toLocalIterator():  # at most one row a block: 4 MB together
        at = r["block"] * BLOCK
        n = min(BLOCK, len(h.cells) - at)
        h.cells[at : at + n] += np.frombuffer(r["cells"], np.int64)[:n]
    return h


def top_values(df: DataFrame, col: str, k: int = 10, keep_factor: int = 32, depth: int = 5, width_bits: int = 14, widen: int = 4) -> DataFrame:
    """The ``k`` most frequent values of an integer column.

    Output: val, approx_rows (sketch estimate), n_rows (counted in the second scan), rank, sure.
    ``keep_factor * k`` prefixes stay open at each level: with the sketch's size, the bound on memory.
    ``sure`` says that no prefix cut on the way down can hold a value of the top ``k``: its estimate
    with three standard errors of the sketch lies below the k-th exact count. Where it can,
    the descent is repeated with four times the prefixes, ``widen`` times at most, and only
    then reported as not sure. Ties in the exact count go to the smaller value. Nulls are not
    values; fewer than ``k`` distinct values give fewer rows; an empty table gives none.
    """
    spark = df.sparkSession
    h = sketch(df, col, depth, width_bits)
    schema = "val long, approx_rows long"
    x = df.select(F.col(col).cast("long").alias("val"))
    keep = keep_factor * k
    for turn in range(widen + 1):
        vals, est, cut = h.descend(keep)
        if not len(vals):
            return spark.createDataFrame([], schema).selectExpr("val", "approx_rows", "0L as n_rows", "0 as rank", "true as sure")
        exact = x.where(F.col("val").isin([int(v) for v in vals])).groupBy("val").agg(F.count(F.lit(1)).alias("n_rows"))
        best = exact.orderBy(F.desc("n_rows"), "val").limit(k).collect()  # the top-k report itself
        sure = bool(best) and (cut < best[-1]["n_rows"] if len(best) == k else cut <= 0)
        if sure:
            break
        keep *= 4
    approx = dict(zip(vals.tolist(), est.tolist()))
    rows = [(r["val"], approx[r["val"]], r["n_rows"], i + 1, bool(sure)) for i, r in enumerate(best)]
    return spark.createDataFrame(rows, "val long, approx_rows long, n_rows long, rank int, sure boolean")

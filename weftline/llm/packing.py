"""Problem 7: filling fixed-capacity containers by harmonic packing.

Lengths fall into reciprocal-capacity classes: class i holds lengths in (C/(i+1), C/i], and a
container of class i takes exactly i of them. Since a length is one of C integers, the classes
are described by a histogram of at most C counters whatever the number of documents; from it
the driver draws up the containers of each class, longest lengths first. Plain harmonic packing
leaves up to 1/(i+1) of such a container empty, so its room is then topped up from the
histogram of the smaller classes, largest fitting length first. The plan says for each length
which ranks go to which containers; workers number the documents of a length and look their
container up, each independently of the others.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one length that one worker numbers.
RANK_ROWS = 200_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc, n_tokens of every non-empty text, counted whole."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    src = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return src.mapInArrow(run, "doc long, n_tokens long")


def plan(hist: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, first container, items a container) and the containers used."""
    left = np.zeros(capacity + 2, np.int64)
    for n, c in hist.items():
        left[n] = c
    used = np.zeros(capacity + 2, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    total = 0

    # largest length with items left that is <= n, found by path compression
    down = np.arange(capacity + 2)

    def fit(n: int) -> int:
        n = max(n, 0)
        path = []
        while n > 0 and left[n] == 0:
            path.append(n)
            n = int(down[n]) if down[n] < n else n - 1
        for p in path:
            down[p] = n
        return n

    def take(n: int, bins: int, per_bin: int, at: int) -> None:
        rows.append((n, int(used[n]), int(used[n] + bins * per_bin), at, per_bin))
        used[n] += bins * per_bin
        left[n] -= bins * per_bin

    def top_up(room: int, bins: int, at: int) -> None:
        """Fill ``bins`` equal containers from ``at`` on with what still fits."""
        todo = [(room, bins, at)]
        while todo:
            room, bins, at = todo.pop()
            n = fit(room)
            if n <= 0 or not bins:
                continue
            if left[n] >= bins:
                t = int(min(room // n, left[n] // bins))
                take(n, bins, t, at)
                todo.append((room - t * n, bins, at))
            else:
                h = int(left[n])
                take(n, h, 1, at)
                todo += [(room, bins - h, at + h), (room - n, h, at)]

    n = fit(capacity)
    while n > 0:
        i = capacity // n  # the harmonic class: i items a container
        bins = int(left[n]) // i
        if bins:
            take(n, bins, i, total)
            top_up(capacity - i * n, bins, total)
            total += bins
        else:
            # the rest of this length shares one container with the next lengths of its class
            room, held = capacity, 0
            while held < i:
                m = fit(min(n, room))
                if m <= 0 or capacity // m != i:
                    break
                t = int(min(left[m], i - held, room // m))
                take(m, 1, t, total)
                room, held = room - t * m, held + t
            top_up(room, 1, total)
            total += 1
        n = fit(n)
    return np.array(rows, np.int64).reshape(-1, 5), total


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every non-empty text in a container: doc_id, part, token_start, n_tokens, container_id.

    A text over the capacity is cut into full containers (parts 0, 1, ...) and a rest that is
    packed like any other text; no other text is split. Null and empty texts are left out;
    equal texts and repeated ids are items of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    counts = scratch.table(token_counts(docs, doc, text, vocabulary), "counts")
    cut = counts.select("doc", "n_tokens", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part"))
    items = cut.select("doc", "part", (F.col("part").cast("long") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part").cast("long") * capacity).cast("int").alias("n"))
    hist = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}  # at most `capacity` rows
    if not hist:
        return spark.createDataFrame([], f"{doc} long, part int, token_start long, n_tokens int, container_id long")
    rows, _ = plan(hist, capacity)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    # one sorted key over (length, rank)
    shift = int(max(hist.values())) + 1
    key = rows[:, 0] * shift + rows[:, 1]

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        r = rows[np.searchsorted(key, n.to_numpy(np.int64) * shift + rank.to_numpy(np.int64), "right") - 1]
        return pd.Series(r[:, 3] + (rank.to_numpy(np.int64) - r[:, 1]) // r[:, 4])

    salts = max(1, -(-max(hist.values()) // RANK_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc", "part"), F.lit(salts)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("doc", "part")) - 1
    numbered = salted.withColumn("rank", rank.cast("long"))
    if salts > 1:
        before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = salted.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("c")).withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
        numbered = numbered.join(offsets, ["n", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    return numbered.select(F.col("doc").alias(doc), "part", "token_start", F.col("n").alias("n_tokens"), container("n", "rank").alias("container_id"))


def pack_summary(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: items, tokens, containers used, the fewest conceivable (tokens / capacity), share filled, fullest container."""
    p = pack(docs, doc, text, capacity, vocabulary)
    per = p.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).cast("long").alias("least_containers"),
        (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("share_filled"), F.max("t").alias("fullest"),
    )

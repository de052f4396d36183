"""Problem 4: has this key been seen before? Generations of immutable peeling-based filters.

Rows arrive in order of a unique id. Ids are cut into batches (generations), each about as
long as all before it, so their number grows with the logarithm of the ids. Inside a batch
keys are handled exactly: a row is seen if a row of the same batch with a smaller id has its
key, so each (key, batch) leaves one representative, which also dissolves hot keys before any
shuffle by key. Keys are sharded by hash; a shard reads its representatives in order of
generation, probes the filters of all sealed generations, and seals its own batch as an xor
filter: 32-bit fingerprints in 1.23 slots a key, built by peeling, about 5 bytes a key. No
earlier key stays in memory. A wrong "seen" has probability 2**-32 per probed filter.

Sealed filters can outlive the run: a ``Store`` is a folder with one table of them per batch.
``seen_in_store`` answers a new batch from the filters of the stored batches alone, reading no
earlier key, and seals the batch behind them. A stored filter belongs to a shard of a power of
two, so batches of any size share one store: a filter made for fewer shards serves all the
finer shards that it covers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.bits import mix
from ..scratch import Scratch

FINGERPRINT_BITS = 32
#: Ids of the first generation; the next are 2, 4, 8, ... times as long.
FIRST_GENERATION = 16_384
#: Keys that one shard should see in all; with 5 bytes a key this bounds a task's filters.
SHARD_KEYS = 500_000


class XorFilter:
    """An immutable filter over distinct uint64 keys."""

    def __init__(self, keys: np.ndarray, bits: int = FINGERPRINT_BITS):
        self.bits, self.n = bits, len(keys)
        self.third = int(math.ceil((1.23 * self.n + 32) / 3))
        for seed in range(1, 100):
            self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
            if self._peel(keys):
                return
        raise RuntimeError("no seed peels; are the keys distinct?")

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + self.seed)
        t = np.uint64(self.third)
        lo = np.uint64((1 << 21) - 1)
        if self.third < 1 << 20:
            slots = [((h >> np.uint64(21 * j)) & lo) * t >> np.uint64(21) for j in range(3)]
        else:
            slots = [(mix(h + np.uint64(j + 1)) >> np.uint64(32)) * t >> np.uint64(32) for j in range(3)]
        slots = np.stack([s.astype(np.int64) + j * self.third for j, s in enumerate(slots)])
        fp = (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64((1 << self.bits) - 1)).astype(np.uint32)
        return slots, fp

    def _peel(self, keys: np.ndarray) -> bool:
        slots, fp = self._hash(keys)
        m = 3 * self.third
        degree = np.bincount(slots.ravel(), minlength=m)
        ids = np.arange(self.n, dtype=np.int64)
        # sum of the key numbers in a slot: with degree 1 it names the key
        owner = np.zeros(m, np.int64)
        for j in range(3):
            owner += np.bincount(slots[j], weights=ids, minlength=m).astype(np.int64)
        rounds, left = [], self.n
        free = np.flatnonzero(degree == 1)
        while left:
            if not len(free):
                return False
            key, first = np.unique(owner[free], return_index=True)
            slot = free[first]
            rounds.append((key, slot))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(owner, touched, np.tile(key, 3))
            touched = np.unique(touched)
            free = touched[degree[touched] == 1]
        table = np.zeros(m, np.uint32)
        for key, slot in reversed(rounds):
            a, b, c = slots[:, key]
            table[slot] = fp[key] ^ table[a] ^ table[b] ^ table[c]  # its own slot is still 0
        self.table = table
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not self.n or not len(keys):
            return np.zeros(len(keys), bool)
        s, fp = self._hash(keys)
        return (self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]) == fp

    def packed(self) -> tuple[int, int, int, bytes]:
        """keys, bits, seed and slots: all that ``restored`` needs."""
        return self.n, self.bits, int(self.seed.view(np.int64)), self.table.tobytes()

    @classmethod
    def restored(cls, n: int, bits: int, seed: int, slots: bytes) -> XorFilter:
        f = cls.__new__(cls)
        f.n, f.bits, f.seed, f.table = n, bits, np.int64(seed).view(np.uint64), np.frombuffer(slots, np.uint32)
        f.third = len(f.table) // 3
        return f

    @property
    def nbytes(self) -> int:
        return self.table.nbytes


def compounded_error(generations: int, bits: int = FINGERPRINT_BITS) -> float:
    """Probability that a new key is called seen by any of ``generations`` sealed filters."""
    return -math.expm1(generations * math.log1p(-(2.0**-bits)))


def generation(o, first: int):
    """Number of the generation of an id counted from 0: the g-th ends at ``first * (2**g - 1)``."""
    return F.floor(F.log2(F.expr(f"{o} div {first} + 1"))).cast("int")


def representatives(df: DataFrame, key: str, order: str, first: int) -> DataFrame:
    """First row of each (key, generation): k, gen, first. Combined on the map side."""
    t = df.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o")).where("k is not null and o is not null")
    return t.groupBy("k", generation("o", first).alias("gen")).agg(F.min("o").alias("first"))


def probe(reps: DataFrame, shards: int, bits: int = FINGERPRINT_BITS, pending: int = 1 << 20) -> DataFrame:
    """Representatives with ``seen`` (an earlier generation holds the key) and ``probed`` (filters asked)."""

    def run(batches):
        shard, gen, filters, held = None, None, [], []

        def flush():
            """Answer one generation of one shard, then seal it."""
            if not held:
                return
            k = np.concatenate([h[0] for h in held])
            first = np.concatenate([h[1] for h in held])
            held.clear()
            u = mix(k.view(np.uint64))
            seen = np.zeros(len(u), bool)
            for f in filters:
                todo = np.flatnonzero(~seen)
                seen[todo] = f.has(u[todo])
            # a key that an earlier filter already answers need not be stored again
            new = u[~seen]
            asked = len(filters)
            if len(new):
                filters.append(XorFilter(new, bits))
            for i in range(0, len(k), pending):
                j = slice(i, i + pending)
                yield pa.RecordBatch.from_pydict({"first": pa.array(first[j]), "seen": pa.array(seen[j]), "probed": pa.array(np.full(len(k[j]), asked, np.int32))})

        for b in batches:
            s, g, k, first = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero((s[1:] != s[:-1]) | (g[1:] != g[:-1])) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(s)]):
                if lo == hi:
                    continue
                if (s[lo], g[lo]) != (shard, gen):
                    yield from flush()
                    if s[lo] != shard:
                        filters.clear()
                    shard, gen = s[lo], g[lo]
                held.append((k[lo:hi], first[lo:hi]))
        yield from flush()

    keyed = reps.select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"), "gen", "k", "first")
    return keyed.repartition(shards, "shard").sortWithinPartitions("shard", "gen").mapInArrow(run, "first long, seen boolean, probed int")


def seen_before(df: DataFrame, key: str, order: str, first_generation: int = FIRST_GENERATION, bits: int = FINGERPRINT_BITS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame]:
    """(answers, status).

    ``answers``: order id of every row whose key arrived before (one row per row of ``df``).
    ``status``: per representative first, seen, probed, for the error report. ``order`` must
    be unique. Rows with a null key or id are never seen and hide nothing; repeated rows have
    their own id and are seen; empty tables give no rows.
    """
    spark = df.sparkSession
    span = df.agg(F.min(F.col(order).cast("long")).alias("lo"), F.count(F.lit(1)).alias("n")).first()
    rows, lo = span["n"], span["lo"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_keys))
    shifted = df.select(F.col(key).cast("long").alias("k"), (F.col(order).cast("long") - F.lit(lo)).alias("o"))
    status = Scratch(spark, "seen").table(probe(representatives(shifted, "k", "o", first_generation), shards, bits), "status")
    fresh = status.where("not seen").select((F.col("first") + F.lit(lo)).alias("_first"))
    ids = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("long").alias("_first"))
    return ids.join(fresh, "_first", "left_anti").withColumnRenamed("_first", order), status


_FILTER = "gen int, shards int, shard int, n long, bits int, seed long, slots binary"


class Store:
    """Sealed filters in a folder that all executors share: one table a batch, no keys."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the sealed batches; a batch counts once its table is complete."""
        if not self._fs.exists(self._at):
            return []
        done = lambda p: self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[6:]) for s in self._fs.listStatus(self._at) if s.getPath().getName().startswith("batch-") and done(s.getPath()))

    def filters(self) -> DataFrame:
        got = self.batches()
        if not got:
            return self.spark.createDataFrame([], _FILTER)
        return self.spark.read.schema(_FILTER).parquet(*[f"{self.path}/batch-{g:06d}" for g in got])

    def seal(self, filters: DataFrame) -> None:
        n = max(self.batches(), default=-1) + 1
        filters.withColumn("gen", F.lit(n)).select(*[x.split()[0] for x in _FILTER.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/batch-{n:06d}")


def seen_in_store(batch: DataFrame, key: str, order: str, store: Store, bits: int = FINGERPRINT_BITS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, float]:
    """(answers, compounded error rate): order ids of the rows of a new batch whose key a stored batch or an earlier row of the batch has.

    Reads the new batch and the stored filters, no earlier key; then seals the batch. A task
    holds the keys of one shard and one filter at a time. Nulls, repeats and empty batches as in
    ``seen_before``; an empty batch seals nothing.
    """
    spark = batch.sparkSession
    scratch = Scratch(spark, "stored")
    t = batch.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o")).where("k is not null and o is not null")
    reps = scratch.table(t.groupBy("k").agg(F.min("o").alias("first")), "reps")
    n = reps.count()
    if not n:
        return t.select(F.col("o").alias(order)), 0.0
    old = store.filters()
    most = old.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]
    shards = max(most, 1 << math.ceil(math.log2(max(1, -(-n // shard_keys)))))

    def run(batches):
        shard, ks, firsts, seen, probed = None, [], [], None, 0

        def answer():
            nonlocal seen
            k, first = np.concatenate(ks), np.concatenate(firsts)
            u = mix(k.view(np.uint64))
            if seen is None:
                seen = np.zeros(len(k), bool)
            new = u[~seen]
            none = [None] * len(k)
            yield pa.RecordBatch.from_pydict({"first": pa.array(first), "seen": pa.array(seen), "probed": pa.array(np.full(len(k), probed, np.int32)), "shard": pa.array(none, pa.int32()), "n": pa.array(none, pa.int64()), "seed": pa.array(none, pa.int64()), "slots": pa.array(none, pa.binary())})
            if len(new):
                m, _, seed, slots = XorFilter(new, bits).packed()
                yield pa.RecordBatch.from_pydict({"first": pa.array([None], pa.int64()), "seen": pa.array([None], pa.bool_()), "probed": pa.array([None], pa.int32()), "shard": pa.array([int(shard)], pa.int32()), "n": pa.array([m], pa.int64()), "seed": pa.array([seed], pa.int64()), "slots": pa.array([slots], pa.binary())})

        for b in batches:
            for s, part in _by_shard(b):
                if s != shard:
                    if ks:
                        yield from answer()
                    shard, ks, firsts, seen, probed = s, [], [], None, 0
                is_key = part.column("slots").is_null().to_numpy(zero_copy_only=False)
                if is_key.any():
                    ks.append(part.column("k").filter(pa.array(is_key)).to_numpy(zero_copy_only=False))
                    firsts.append(part.column("first").filter(pa.array(is_key)).to_numpy(zero_copy_only=False))
                if not is_key.all() and ks:
                    u = mix(np.concatenate(ks).view(np.uint64))
                    if seen is None:
                        seen = np.zeros(len(u), bool)
                    for i in np.flatnonzero(~is_key):
                        f = XorFilter.restored(part.column("n")[int(i)].as_py(), part.column("bits")[int(i)].as_py(), part.column("seed")[int(i)].as_py(), part.column("slots")[int(i)].as_py())
                        todo = np.flatnonzero(~seen)
                        seen[todo] = f.has(u[todo])
                        probed += 1
        if ks:
            yield from answer()

    null = lambda kind: F.lit(None).cast(kind)
    keys = reps.select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("gen"), "k", "first", null("long").alias("n"), null("int").alias("bits"), null("long").alias("seed"), null("binary").alias("slots"))
    finer = F.explode(F.expr(f"transform(sequence(0, {shards} div shards - 1), i -> shard + i * shards)"))
    asked = old.select(finer.alias("shard"), "gen", null("long").alias("k"), null("long").alias("first"), "n", "bits", "seed", "slots")
    # keys of a shard come first (gen -1), then its filters one by one
    both = keys.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "gen")
    out = scratch.table(both.mapInArrow(run, "first long, seen boolean, probed int, shard int, n long, seed long, slots binary"), "answers")
    fresh = out.where("first is not null and not seen").select(F.col("first").alias("_first"))
    got = t.select(F.col("o").alias("_first")).join(fresh, "_first", "left_anti").withColumnRenamed("_first", order)
    got = scratch.table(got, "seen")
    store.seal(out.where("slots is not null").select(F.lit(shards).alias("shards"), "shard", "n", F.lit(bits).alias("bits"), "seed", "slots"))
    return got, compounded_error(len(store.batches()) - 1, bits)


def _by_shard(b: pa.RecordBatch):
    s = b.column("shard").to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(s[1:] != s[:-1]) + 1
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(s)]):
        if hi > lo:
            yield int(s[lo]), b.slice(int(lo), int(hi - lo))


def error_report(df: DataFrame, key: str, order: str, first_generation: int = FIRST_GENERATION, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row: rows, answered seen, wrongly seen, wrongly new, measured and compounded error rate.

    The truth is the exact first id per key, an aggregation that exists here only for the measurement.
    """
    got, status = seen_before(df, key, order, first_generation, bits)
    t = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"))
    first = t.groupBy("k").agg(F.min("o").alias("o")).select("o", F.lit(1).alias("is_first"))
    j = t.select("o").join(first, "o", "left").join(got.select(F.col(order).alias("o"), F.lit(1).alias("said")), "o", "left")
    n = j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("said"), F.lit(0)).cast("long").alias("n_seen"),
        F.count_if(F.col("said").isNotNull() & F.col("is_first").isNotNull()).alias("wrongly_seen"),
        F.count_if(F.col("said").isNull() & F.col("is_first").isNull()).alias("wrongly_new"),
    )
    most = status.agg(F.coalesce(F.max("probed"), F.lit(0)).alias("filters_probed"))
    rate = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise((F.col("wrongly_seen") + F.col("wrongly_new")) / F.col("n_rows"))
    bound = -F.expm1(F.col("filters_probed") * F.log1p(F.lit(-(2.0**-bits))))
    return n.join(F.broadcast(most)).select("n_rows", "n_seen", "wrongly_seen", "wrongly_new", rate.alias("measured_rate"), bound.alias("compounded_bound"), "filters_probed")

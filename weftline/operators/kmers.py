"""k-mers, minimizers and their frequency tables.

k-mers travel as two-bit codes (8 bytes for k up to 31) and are counted per Arrow batch before
the shuffle, so repeats leave a scan task once per batch. Text form is made for results only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import hash64
from ..kernels.bits import CODE, letter_runs, mix, packed, packed_reverse, sliding_min, text_slices

#: Counts saturate here (12 bits); counts of parental dumps saturate at PARENT_MAX.
COUNT_MAX, PARENT_MAX = 4095, 1023


def _places(lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Start positions of all k-mers in runs [lo, hi)."""
    n = hi - lo - k + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def kmer_counts(reads: DataFrame, k: int, seq: str = "seq", saturate: int = COUNT_MAX) -> DataFrame:
    """code, cnt of every canonical k-mer (k <= 31) without other letters than A, C, G, T.

    Null and short sequences have none; counts stop at ``saturate``; an empty table gives no rows.
    """

    def run(batches):
        for _, data, off in (x for b in batches for x in text_slices(None, b.column(0))):
            code = CODE[data]
            lo, hi, _ = letter_runs(code, off, k)
            at = _places(lo, hi, k)
            if not len(at):
                continue
            c = np.minimum(packed(code, k)[at], packed_reverse(code, k)[at])
            v, n = np.unique(c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["code", "n"])

    t = reads.select(F.col(seq)).where(F.length(seq) >= k).mapInArrow(run, "code long, n long")
    return t.groupBy("code").agg(F.least(F.sum("n"), F.lit(saturate)).alias("cnt"))


def long_kmer_counts(reads: DataFrame, k: int, seq: str = "seq", saturate: int = COUNT_MAX) -> DataFrame:
    """hi, lo, cnt of every canonical k-mer of 33 to 63 letters: ``lo`` its last 32 letters, ``hi`` those before.

    Otherwise as ``kmer_counts``.
    """
    if not 33 <= k <= 63:
        raise ValueError("k must be 33 to 63")
    n_hi = k - 32

    def run(batches):
        for _, data, off in (x for b in batches for x in text_slices(None, b.column(0))):
            code = CODE[data]
            lo, hi, _ = letter_runs(code, off, k)
            at = _places(lo, hi, k)
            if not len(at):
                continue
            a, b = packed(code, n_hi)[at], packed(code, 32)[at + n_hi]
            ra, rb = packed_reverse(code, n_hi)[at + 32], packed_reverse(code, 32)[at]
            own = (a < ra) | ((a == ra) & (b <= rb))
            a, b = np.where(own, a, ra), np.where(own, b, rb)
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.diff(np.append(first, len(a))))], names=["hi", "lo", "n"])

    t = reads.select(F.col(seq)).where(F.length(seq) >= k).mapInArrow(run, "hi long, lo long, n long")
    return t.groupBy("hi", "lo").agg(F.least(F.sum("n"), F.lit(saturate)).alias("cnt"))


def decode_long(hi: Column, lo: Column, k: int) -> Column:
    return F.concat(decode(hi, k - 32), decode(lo, 32))


#: Bits of a code filter: 256 a code, up to 2^28 (32 MB), made in chunks of 2^19 (64 KB). One in 256 of the other codes gets through, one in 16 from 2^24 codes.
FILTER_BITS, FILTER_CHUNK = 28, 19


def code_filter(codes: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of hashed codes (column ``code`` of a written table) for ``kmer_positions`` and ``passing``: never misses a code, lets some others through.

    At most 2^most bits reach the driver, however many codes there are.
    """
    bits = min(most, max(FILTER_CHUNK, math.ceil(math.log2(256 * codes.count() + 1))))

    def place(batches):
        for b in batches:
            h = mix(b.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(FILTER_CHUNK)).astype(np.int32)), pa.array((h & np.uint64((1 << FILTER_CHUNK) - 1)).astype(np.int32))], names=["chunk", "at"])

    def fill(t: pa.Table) -> pa.Table:
        m = np.zeros(1 << FILTER_CHUNK, bool)
        m[t.column("at").to_numpy()] = True
        return pa.table({"chunk": t.column("chunk")[:1], "bits": pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << (bits - FILTER_CHUNK), 1 << (FILTER_CHUNK - 3)), np.uint8)
    for r in codes.select("code").where("code is not null").mapInArrow(place, "chunk int, at int").groupBy("chunk").applyInArrow(fill, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _let_through(code: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Which codes a ``code_filter`` lets through."""
    h = mix(code) & np.uint64(len(only) * 8 - 1)
    return (only[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0


def passing(t: DataFrame, key: str, only: np.ndarray) -> DataFrame:
    """Rows of ``t`` that a ``code_filter`` of the values of ``key`` (long, not null) lets through: all with such a value and some others."""
    sent = t.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_let_through(b.column(key).to_numpy().view(np.uint64), sent.value)))

    return t.mapInArrow(run, t.schema)


def kmer_positions(reads: DataFrame, k: int, record: str = "rid", seq: str = "seq", only: np.ndarray | None = None) -> DataFrame:
    """rid, pos, code, rev of every k-mer: canonical code, and whether the reverse complement is the smaller.

    ``only``: a ``code_filter``; k-mers that it rules out are left out, those that it lets through wrongly stay.
    The table is hundreds of times what Catalyst expects, so joins on it need a hint that rules out a broadcast.
    """
    sent = None if only is None else reads.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for rid, data, off in (x for b in batches for x in text_slices(b.column(0), b.column(1))):
            code = CODE[data]
            lo, hi, rec = letter_runs(code, off, k)
            at = _places(lo, hi, k)
            if not len(at):
                continue
            owner = np.repeat(rec, hi - lo - k + 1)
            f, r = packed(code, k)[at], packed_reverse(code, k)[at]
            if sent is not None:
                ok = _let_through(np.minimum(f, r), sent.value)
                at, owner, f, r = at[ok], owner[ok], f[ok], r[ok]
            yield pa.RecordBatch.from_arrays([pa.array(rid[owner]), pa.array((at - off[owner]).astype(np.int32)), pa.array(np.minimum(f, r).view(np.int64)), pa.array((r < f).astype(np.int32))], names=["rid", "pos", "code", "rev"])

    return reads.select(F.col(record).cast("long"), F.col(seq)).where(f"{record} is not null and length({seq}) >= {k}").mapInArrow(run, "rid long, pos int, code long, rev int")


def _mixed(code: np.ndarray, bits: int) -> np.ndarray:
    """``functions.seq.hash64`` on an array."""
    m = np.uint64((1 << bits) - 1)
    k = code.astype(np.uint64)

    def s(n: int) -> np.ndarray:
        return (k << np.uint64(n)) & m

    k = (m - k + s(21)) & m
    k = k ^ (k >> np.uint64(24))
    k = (k + s(3) + s(8)) & m
    k = k ^ (k >> np.uint64(14))
    k = (k + s(2) + s(4)) & m
    k = k ^ (k >> np.uint64(28))
    return (k + s(31)) & m


def minimizers(reads: DataFrame, k: int, w: int, record: str = "rid", seq: str = "seq", frequent: dict[int, int] | None = None, dropped: list[int] | None = None) -> DataFrame:
    """rid, pos, code, h, rev: k-mers with the smallest key in some window of ``w`` k-mers.

    The key is (frequency class, hash); ``frequent`` maps the codes of a bounded filter table
    to their counts (absent codes count as 0), ``dropped`` codes never are minimizers. k-mers
    that equal their reverse complement are passed over. Equal keys in a window are all kept.
    Windows lie within a run of A, C, G, T; runs with fewer than ``w`` k-mers form one window.
    """
    bits = 2 * k
    fk = np.array(sorted(frequent or {}), np.int64).view(np.uint64)
    fv = np.array([(frequent or {})[int(c)] for c in fk.view(np.int64)], np.int64)
    dk = np.array(sorted(dropped or []), np.int64).view(np.uint64)
    if bits + 13 > 64:
        raise ValueError("k is at most 25 here")

    def run(batches):
        for rid, data, off in (x for b in batches for x in text_slices(b.column(0), b.column(1))):
            code = CODE[data]
            lo, hi, rec = letter_runs(code, off, k)
            n = hi - lo - k + 1
            at = _places(lo, hi, k)
            if not len(at):
                continue
            f, r = packed(code, k)[at], packed_reverse(code, k)[at]
            c = np.minimum(f, r)
            h = _mixed(c, bits)
            key = h.copy()
            if len(fk):
                i = np.minimum(np.searchsorted(fk, c), len(fk) - 1)
                key |= np.where(fk[i] == c, np.minimum(fv[i], COUNT_MAX), 0).astype(np.uint64) << np.uint64(bits)
            never = f == r
            if len(dk):
                i = np.minimum(np.searchsorted(dk, c), len(dk) - 1)
                never |= dk[i] == c
            top = np.uint64(0xFFFFFFFFFFFFFFFF)
            key[never] = top
            # window minima per run: pad each run so that windows of neighbours never mix
            pick = np.zeros(len(key), bool)
            end = np.cumsum(n)
            width = np.minimum(n, w)
            for size in np.unique(width):
                runs = np.flatnonzero(width == size)
                idx = _places(end[runs] - n[runs], end[runs], 1)
                m = sliding_min(key[idx], int(size))
                starts = np.cumsum(n[runs]) - n[runs]
                ws = _places(starts, starts + n[runs], int(size))
                mine, mark = key[idx], np.zeros(len(idx), bool)
                for j in range(int(size)):
                    mark[ws + j] |= m[ws] == mine[ws + j]
                pick[idx] = mark
            pick &= key != top
            owner = np.repeat(rec, n)
            yield pa.RecordBatch.from_arrays([pa.array(rid[owner][pick]), pa.array((at - off[owner])[pick].astype(np.int32)), pa.array(c[pick].view(np.int64)), pa.array(h[pick].view(np.int64)), pa.array((r < f)[pick].astype(np.int32))], names=["rid", "pos", "code", "h", "rev"])

    return reads.select(F.col(record).cast("long"), F.col(seq)).where(f"{record} is not null and length({seq}) >= {k}").mapInArrow(run, "rid long, pos int, code long, h long, rev int")


def decode(code: Column, k: int) -> Column:
    """Letters of a two-bit code; for results, not for shuffles."""
    letters = F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.substring(F.lit("ACGT"), F.call_function("shiftright", code, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))
    return F.array_join(letters, "")


def histogram(counts: DataFrame, cnt: str = "cnt") -> DataFrame:
    """n k-mers per count: at most COUNT_MAX rows."""
    return counts.groupBy(F.col(cnt).cast("int").alias("cnt")).agg(F.count(F.lit(1)).alias("n"))


def filter_table(counts: DataFrame, cutoff: int, max_kept: int) -> DataFrame:
    """Frequent k-mers (cnt >= cutoff): class ``rescue`` up to max_kept, ``drop`` above."""
    return counts.where(F.col("cnt") >= cutoff).withColumn("cls", F.when(F.col("cnt") > max_kept, "drop").otherwise("rescue"))


def rescue_frequent(mz: DataFrame, least: int, gap: int = 500, most: int = 16) -> DataFrame:
    """In each streak of frequent minimizers of a record keep the round(length / gap) least frequent (``most`` at most).

    ``mz``: rid, pos, cnt. A streak is a maximal run of neighbours with cnt >= ``least``. Rows
    below ``least`` are all kept.
    """
    w = Window.partitionBy("rid").orderBy("pos")
    t = mz.withColumn("hot", F.col("cnt") >= least)
    t = t.withColumn("edge", (F.col("hot") & ~F.coalesce(F.lag("hot").over(w), F.lit(False))).cast("int")).withColumn("streak", F.sum("edge").over(w))
    s = Window.partitionBy("rid", "streak", "hot")
    n = F.least(F.lit(most), F.round((F.max("pos").over(s) - F.min("pos").over(s)) / gap)).cast("int")
    t = t.withColumn("n_keep", n).withColumn("rank", F.row_number().over(s.orderBy("cnt", "pos")))
    return t.where("not hot or rank <= n_keep").select("rid", "pos", "cnt", "hot")


def hash_of_code(code: Column, k: int) -> Column:
    return hash64(code, 2 * k)

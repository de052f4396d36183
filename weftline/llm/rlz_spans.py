"""Problem 1: long exact spans shared between records, by relative Lempel-Ziv parsing in blocks.

Factoring every record against every reference block would be quadratic, so blocks are made
by content: all windows of ``min_len`` letters that share a minimizer (the smallest hash of
their k-mers) go to the same block, as a piece of text spanning a run of such windows. Equal
windows have equal minimizers, so a piece needs to be factored against the index of its own
block only, and nothing is lost. Letters are packed two bits each.

In a block, the index holds every window start of every piece, ordered by fingerprint of the
window. A piece is parsed greedily: at the first start that another record holds, the longest
match with a neighbour in the index is a factor; starts inside a factor whose own match crosses
its end are checked at that boundary and carry the span on; else the next factor begins
behind it. Factors are at least ``min_len`` long, hence duplicate spans.

Skew: equal pieces of one slice of the input leave the scan as one row, and blocks keep equal pieces
once, so copies don't pile up; spans of a piece with several holders go back to the holders
by a join on the piece's key. Minimizers that bring over a fixed number of pieces (a bounded list) rank
last, so that their windows spread over other minimizers; windows with none but such
minimizers are compared one by one in a plain aggregation by window, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.bits import CODE, letter_runs, mix, packed, sliding_min, text_slices
from ..scratch import Scratch

#: Most minimizers that may be held as hot: 8 MB of keys, sent to the workers once.
HOT_KEYS = 1_000_000
HOT_BIT = np.uint64(1 << 63)
NO_KEYS = np.zeros(0, np.uint64)


def piece_words(min_len: int) -> int:
    """Words of 32 letters in a piece: room for 92 window starts at least."""
    return max(6, -(-(min_len + 91) // 32))


def pieces(rid: np.ndarray, data: np.ndarray, off: np.ndarray, min_len: int, k: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of window starts with one minimizer: mz, w0.., n (letters), rid, pos."""
    n_words = piece_words(min_len)
    code = CODE[data]
    lo, hi, rec = letter_runs(code, off, min_len)
    none = {"mz": np.zeros(0, np.int64), "n": np.zeros(0, np.int32), "rid": np.zeros(0, np.int64), "pos": np.zeros(0, np.int32)} | {f"w{j}": np.zeros(0, np.int64) for j in range(n_words)}
    if not len(lo):
        return none
    size = hi - lo
    at = np.concatenate([[0], np.cumsum(size)])
    src = np.arange(at[-1]) + np.repeat(lo - at[:-1], size)
    letters = code[src]
    c32 = packed(letters, 32)
    h = mix(packed(letters, k)[: len(letters)]) >> np.uint64(1)
    if len(hot):
        h = np.where(np.isin(h, hot), h | HOT_BIT, h)
    m = sliding_min(h, min_len - k + 1)
    # window starts of each run
    nwin = size - min_len + 1
    wat = np.concatenate([[0], np.cumsum(nwin)])
    run = np.repeat(np.arange(len(lo)), nwin)
    start = np.arange(wat[-1]) - wat[run] + at[run]
    mv = m[start]
    new = np.ones(len(mv), bool)
    new[1:] = (mv[1:] != mv[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(mv)))
    most = 32 * n_words - min_len + 1
    if (length > most).any():  # repeats keep one minimizer for long: cut, as starts are compared one by one anyway
        extra = -(-length // most)
        base = np.repeat(first, extra)
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
        left = np.repeat(length, extra) - step * most
        first, length = base + step * most, np.minimum(left, most)
    a, n = start[first], length + min_len - 1
    out = {"mz": mv[first].view(np.int64), "n": n.astype(np.int32), "rid": rid[rec[run[first]]], "pos": (src[a] - off[rec[run[first]]]).astype(np.int32)}
    for j in range(n_words):
        valid = np.clip(n - 32 * j, 0, 32)
        w = c32[np.minimum(a + 32 * j, len(c32) - 1)]
        w = np.where(valid == 32, w, (w >> (np.uint64(64) - 2 * np.maximum(valid, 1).astype(np.uint64))) << (np.uint64(64) - 2 * np.maximum(valid, 1).astype(np.uint64)))
        out[f"w{j}"] = np.where(valid == 0, np.uint64(0), w).view(np.int64)
    return out


def piece_key(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a piece's letters and length."""
    a = mix(p["n"].astype(np.uint64) + np.uint64(0x51))
    b = mix(p["n"].astype(np.uint64) + np.uint64(0xC3))
    for j in range(len(p) - 4):
        w = p[f"w{j}"].view(np.uint64)
        a = mix(a ^ w)
        b = mix(b + w * np.uint64(0x9E3779B97F4A7C15))
    return a.view(np.int64), b.view(np.int64)


def window_words(w: np.ndarray, piece: np.ndarray, o: np.ndarray, n: int) -> list[np.ndarray]:
    """n letters from offset o of each piece, in words of 32, zero-padded."""
    out, last = [], w.shape[1] - 1
    for j in range(-(-n // 32)):
        at = o + 32 * j
        q, r = at // 32, (2 * (at % 32)).astype(np.uint64)
        hi = w[piece, np.minimum(q, last)] * (q <= last)
        lo = w[piece, np.minimum(q + 1, last)] * (q < last)
        x = (hi << r) | np.where(r == 0, np.uint64(0), lo >> ((np.uint64(64) - r) & np.uint64(63)))
        left = n - 32 * j
        if left < 32:
            cut = np.uint64(64 - 2 * left)
            x = (x >> cut) << cut
        out.append(x)
    return out


def common_letters(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal leading letters of two 32-letter words."""
    d = x ^ y
    out = np.full(len(d), 32, np.int64)
    nz = d != 0
    # position of the highest set bit through the exponent of the upper and lower halves
    hi, lo = (d >> np.uint64(32)).astype(np.float64), (d & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bit = np.where(hi > 0, 32 + np.frexp(hi)[1], np.frexp(lo)[1])
    out[nz] = ((64 - bit[nz]) // 2).astype(np.int64)
    return out


def parse_block(w: np.ndarray, n: np.ndarray, mz: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of every piece of a block against the others: (piece, start, end) of the spans."""
    # a minimizer that one record alone holds has no partner
    order = np.argsort(mz, kind="stable")
    g = np.flatnonzero(np.r_[True, mz[order][1:] != mz[order][:-1]])
    alone = np.minimum.reduceat(rmin[order], g) == np.maximum.reduceat(rmax[order], g)
    cand = order[~np.repeat(alone, np.diff(np.append(g, len(order))))]
    if not len(cand):
        z = np.zeros(0, np.int64)
        return z, z, z
    cand = np.sort(cand)
    starts = n[cand].astype(np.int64) - min_len + 1
    base = np.concatenate([[0], np.cumsum(starts)])
    piece = np.repeat(cand, starts)
    o = np.arange(base[-1]) - np.repeat(base[:-1], starts)
    words = window_words(w, piece, o, min_len)
    f = np.zeros(len(o), np.uint64)
    for x in words:
        f = mix(f ^ x)
    index = np.argsort(f, kind="stable")
    same = np.ones(len(index) - 1, bool)
    for x in words:
        s = x[index]
        same &= s[1:] == s[:-1]
    g = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.append(g, len(index)))
    owner_lo, owner_hi = rmin[piece[index]], rmax[piece[index]]
    shared = np.repeat(np.minimum.reduceat(owner_lo, g) != np.maximum.reduceat(owner_hi, g), sizes)
    # longest match with a neighbour of another owner in the index
    match = np.where(shared, min_len, 0).astype(np.int64)
    pair = np.flatnonzero(same & ((owner_lo[1:] != owner_lo[:-1]) | (owner_hi[1:] != owner_hi[:-1])))
    if len(pair):
        p, q = index[pair], index[pair + 1]
        room = np.minimum(n[piece[p]] - o[p], n[piece[q]] - o[q]).astype(np.int64) - min_len
        more, going = np.zeros(len(pair), np.int64), np.ones(len(pair), bool)
        for step in range(0, int(room.max(initial=0)), 32):
            a, b = (window_words(w, piece[i], o[i] + min_len + step, 32)[0] for i in (p, q))
            c = common_letters(a, b)
            more += np.where(going, c, 0)
            going &= c == 32
        more = np.minimum(more, room)
        np.maximum.at(match, pair, min_len + more)
        np.maximum.at(match, pair + 1, min_len + more)
    found = np.zeros(len(o), np.int64)
    found[index] = match
    # greedy parse, all pieces side by side
    big = 1 << 40
    pid = np.repeat(np.arange(len(cand)), starts)
    reach = np.maximum.accumulate(np.where(found > 0, o + found, 0) + pid * big) - pid * big
    nxt = np.minimum.accumulate(np.where(found > 0, np.arange(len(o)), big)[::-1])[::-1]
    last = base[1:] - 1
    live = np.arange(len(cand))
    cur = nxt[base[:-1]]
    out = []
    ok = cur <= last
    live, cur = live[ok], cur[ok]
    while len(live):
        s, e = o[cur], o[cur] + found[cur]
        while True:  # boundary check: a match that starts inside and crosses the end carries the span on
            inside = np.minimum(base[live] + e, last[live])
            further = np.maximum(e, reach[inside])
            if (further == e).all():
                break
            e = further
        out.append((live, s, e))
        after = base[live] + e + 1
        go = after <= last[live]
        live, after = live[go], after[go]
        cur = nxt[after]
        ok = cur <= last[live]
        live, cur = live[ok], cur[ok]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) if i else cand[np.concatenate(x)] for i, x in enumerate(zip(*out)))


def piece_schema(n_words: int) -> str:
    return ", ".join(["mz long", "k1 long", "k2 long", *(f"w{j} long" for j in range(n_words)), "n int", "rlo long", "rhi long", "plo int", "phi int"])


def scan_pieces(reads: DataFrame, min_len: int, k: int, hot, merge: bool) -> DataFrame:
    """Pieces of every record; ``hot``: a broadcast of the hot minimizers or None. ``merge``: equal pieces of a slice become one row (owner and place as ranges)."""
    n_words = piece_words(min_len)
    schema = piece_schema(n_words)

    def run(batches):
        for rid, data, off in (x for b in batches for x in text_slices(b.column(0), b.column(1))):
            p = pieces(rid, data, off, min_len, k, NO_KEYS if hot is None else hot.value)
            if not len(p["n"]):
                continue
            k1, k2 = piece_key(p)
            cols = {"mz": p["mz"], "k1": k1, "k2": k2, **{f"w{j}": p[f"w{j}"] for j in range(n_words)}, "n": p["n"]}
            if merge:
                o = np.lexsort((k2, k1))
                g = np.flatnonzero(np.r_[True, (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])])
                f = o[g]
                cols = {c: v[f] for c, v in cols.items()}
                for c, v in (("rid", p["rid"]), ("pos", p["pos"])):
                    s = v[o]
                    cols[c[0] + "lo"], cols[c[0] + "hi"] = np.minimum.reduceat(s, g), np.maximum.reduceat(s, g)
                cols = {c: cols[c] for c in [x.split()[0] for x in schema.split(", ")]}
            else:
                cols = {"k1": k1, "k2": k2, "rid": p["rid"], "pos": p["pos"]}
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))

    return reads.mapInArrow(run, schema if merge else "k1 long, k2 long, rid long, pos int")


def shared_spans(reads: DataFrame, record: str = "rid", seq: str = "seq", min_len: int = 100, block_pieces: int = 20_000, hot_pieces: int = 50_000) -> DataFrame:
    """Maximal intervals of positions that lie in a span of ``min_len`` letters found in another record.

    Output: x_id, x_pos_s, x_pos_e (0-based, end exclusive; touching intervals are joined).
    Letters compare without case; only A, C, G and T match, on the given strand. Rows that
    carry the same record id are one record: what they share among themselves is not shared.
    Null ids, null and empty sequences and sequences under ``min_len`` give no rows;
    exact copies under another id are shared as a whole. ``min_len`` is 32 or more; pieces
    (and their rows) grow with it.

    A block holds what its minimizers bring, and no minimizer that is not hot brings over
    ``hot_pieces`` pieces, whatever the size of the input, until HOT_KEYS of them would be hot:
    only an input of over HOT_KEYS * hot_pieces pieces (about 1.7e12 letters) raises that limit.
    """
    if min_len < 32:
        raise ValueError("min_len must be 32 or more")
    spark = reads.sparkSession
    k = max(16, min(32, min_len // 3))
    src = reads.select(F.col(record).cast("long").alias("rid"), F.col(seq).cast("string").alias("seq")).where("rid is not null and seq is not null")
    scratch = Scratch(spark, "rlz")

    # about one piece per (window count + 1) / 2 letters
    letters = src.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    expected = 2 * letters // (min_len - k + 2) + 1
    limit = max(hot_pieces, expected // HOT_KEYS)
    hot = None
    if expected > limit:
        counts = scan_pieces(src, min_len, k, None, True).groupBy("mz").agg(F.count(F.lit(1)).alias("c"))
        keys = counts.where(F.col("c") > limit).select("mz").toPandas()["mz"].to_numpy(np.int64)  # at most expected / limit values, hence HOT_KEYS
        if len(keys):
            hot = spark.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
    merged = scan_pieces(src, min_len, k, hot, True)
    blocks, n_words = max(1, expected // block_pieces), piece_words(min_len)

    def parse(t: pa.Table) -> pa.Table:
        c = {f: t.column(f).to_numpy() for f in t.column_names}
        o = np.lexsort((c["k2"], c["k1"]))
        g = np.flatnonzero(np.r_[True, (c["k1"][o][1:] != c["k1"][o][:-1]) | (c["k2"][o][1:] != c["k2"][o][:-1])])
        f = o[g]
        lo = {x: np.minimum.reduceat(c[x][o], g) for x in ("rlo", "plo")}
        hi = {x: np.maximum.reduceat(c[x][o], g) for x in ("rhi", "phi")}
        w = np.stack([c[f"w{j}"][f].view(np.uint64) for j in range(n_words)], axis=1)
        p, s, e = parse_block(w, c["n"][f], c["mz"][f], lo["rlo"], hi["rhi"], min_len)
        solo = (lo["rlo"] == hi["rhi"])[p] & (lo["plo"] == hi["phi"])[p]
        at = np.where(solo, lo["plo"][p], 0)
        return pa.table({
            "k1": c["k1"][f][p], "k2": c["k2"][f][p],
            "x_id": pa.array(lo["rlo"][p], mask=~solo), "s": pa.array(at + s, pa.int64()), "e": pa.array(at + e, pa.int64()),
        })

    out = "k1 long, k2 long, x_id long, s long, e long"
    spans = merged.where(F.col("mz") >= 0).withColumn("block", F.pmod(F.xxhash64("mz"), F.lit(blocks)))
    spans = spans.groupBy("block").applyInArrow(lambda t: parse(t.drop_columns(["block"])), out)
    spans = scratch.table(spans, "spans")
    solo = spans.where("x_id is not null").select("x_id", "s", "e")
    held = scan_pieces(src, min_len, k, hot, False)
    multi = held.join(spans.where("x_id is null").drop("x_id"), ["k1", "k2"]).select(F.col("rid").alias("x_id"), (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e"))
    every = solo.unionByName(multi)
    if hot is not None:
        every = every.unionByName(hot_windows(src, min_len, k, hot))
    return join_touching(every)


def hot_windows(src: DataFrame, min_len: int, k: int, hot) -> DataFrame:
    """The exact way for windows whose k-mers are all hot (a broadcast): compared by window, combined on the map side."""

    def run(batches):
        for rid, data, off in (x for b in batches for x in text_slices(b.column(0), b.column(1))):
            p = pieces(rid, data, off, min_len, k, hot.value)
            sel = np.flatnonzero(p["mz"] < 0)
            if not len(sel):
                continue
            w = np.stack([p[f"w{j}"][sel].view(np.uint64) for j in range(piece_words(min_len))], axis=1)
            cnt = p["n"][sel].astype(np.int64) - min_len + 1
            piece = np.repeat(np.arange(len(sel)), cnt)
            o = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            words = np.stack(window_words(w, piece, o, min_len), axis=1)
            text = pa.Array.from_buffers(pa.binary(8 * words.shape[1]), len(words), [None, pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([text, pa.array(p["rid"][sel][piece]), pa.array(p["pos"][sel][piece] + o)], names=["win", "rid", "s"])

    t = src.mapInArrow(run, "win binary, rid long, s long")
    shared = t.groupBy("win").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select("win")
    return t.join(shared, "win", "left_semi").select(F.col("rid").alias("x_id"), "s", (F.col("s") + min_len).alias("e"))


def join_touching(spans: DataFrame) -> DataFrame:
    """Union of intervals per record, touching ones joined. One shuffle by record."""
    by = Window.partitionBy("x_id").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    t = spans.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
    t = t.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("x_id", "island").agg(F.min("s").alias("x_pos_s"), F.max("e").alias("x_pos_e")).select("x_id", "x_pos_s", "x_pos_e")


def shared_share(reads: DataFrame, record: str = "rid", seq: str = "seq", min_len: int = 100) -> DataFrame:
    """How much of each record is shared elsewhere: x_id, n_letters, shared_letters, shared_share.

    Every non-null record id has a row; a record without shared spans (or without letters) has 0.
    The length of a record delivered several times is its longest.
    """
    n = shared_spans(reads, record, seq, min_len).groupBy("x_id").agg(F.sum(F.col("x_pos_e") - F.col("x_pos_s")).alias("got"))
    r = reads.where(F.col(record).isNotNull()).groupBy(F.col(record).cast("long").alias("x_id")).agg(F.coalesce(F.max(F.length(seq)), F.lit(0)).cast("long").alias("n_letters"))
    got = F.coalesce(F.col("got"), F.lit(0))
    share = F.when(F.col("n_letters") > 0, got / F.col("n_letters")).otherwise(F.lit(0.0))
    return r.join(n, "x_id", "left").select("x_id", "n_letters", got.cast("long").alias("shared_letters"), share.alias("shared_share"))

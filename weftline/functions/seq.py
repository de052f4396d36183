"""Scalar functions on sequences and intervals, as Column expressions that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRED = 33
#: Upper ends of the quality bins and the value that stands for each (fixed values).
QUALITY_ENDS = (10, 20, 30)
QUALITY_OF_BIN = (9, 19, 29, 39)


def encode_bases(seq: Column) -> Column:
    """A, C, G, T (or U) as 0 to 3, anything else as 4."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGTU]", "4"), "ACGTU", "01233")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def sub_region(seq: Column, start: Column, length: Column, rev: Column) -> Column:
    """A part of a sequence by 0-based start, reverse complemented where ``rev``."""
    s = F.substring(seq, start + 1, length)
    return F.when(rev, reverse_complement(s)).otherwise(s)


def collapse_homopolymers(seq: Column) -> Column:
    return F.regexp_replace(seq, "(A)A+|(C)C+|(G)G+|(T)T+", "$1$2$3$4")


def quality_bins(qual: Column) -> Column:
    """Phred+33 text as a text of bins 0 to 3: one translate, no explode."""
    chars = "".join(chr(c) for c in range(PHRED, 127))
    bins = "".join(str(sum(c - PHRED > e for e in QUALITY_ENDS)) for c in range(PHRED, 127))
    return F.translate(qual, chars, bins)


def quality_from_bins(bins: Column) -> Column:
    """Bins back to Phred+33 text, each as the value that stands for it."""
    return F.translate(bins, "0123", "".join(chr(q + PHRED) for q in QUALITY_OF_BIN))


def quality_sum(qual: Column) -> Column:
    """Sum of the Phred values."""
    return F.aggregate(F.split(qual, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - PHRED))


def hash64(key: Column, bits: int = 62) -> Column:
    """Invertible mix of a non-negative integer under 2**bits (bits <= 62), the public 64-bit integer mix of T. Wang.

    Every step is taken modulo 2**bits, so sums stay under 2**63 and no Python is needed.
    """
    mask = (1 << bits) - 1

    def shl(x: Column, n: int) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(mask >> n)), n) if n < bits else F.lit(0).cast("long")

    def add(*xs: Column) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = (out + x).bitwiseAND(F.lit(mask))
        return out

    k = key.cast("long")
    k = add(F.lit(mask) - k, shl(k, 21))
    k = k.bitwiseXOR(F.shiftrightunsigned(k, 24))
    k = add(k, shl(k, 3), shl(k, 8))
    k = k.bitwiseXOR(F.shiftrightunsigned(k, 14))
    k = add(k, shl(k, 2), shl(k, 4))
    k = k.bitwiseXOR(F.shiftrightunsigned(k, 28))
    return add(k, shl(k, 31))


def overlap_type(qs: Column, qe: Column, ql: Column) -> Column:
    """0 left-anchored, 1 right-anchored, 2 whole query, 3 interior."""
    left, right = qs == 0, qe == ql
    return F.when(left & right, 2).when(left, 0).when(right, 1).otherwise(3)


def arc_fields(qn: Column, tn: Column, qs: Column, qe: Column, ql: Column, ts: Column, te: Column, tl: Column, rev: Column, max_hang: int = 1000, rate: float = 0.8, min_ovlp: int = 50) -> Column:
    """String-graph reading of an overlap: struct(kind, u, v, len, ol); kind is ARC, INT, QCONT, TCONT or SHORT.

    Nodes are record * 2 + strand. u, v, len and ol are null unless kind is ARC.
    """
    tl5 = F.when(rev == 1, tl - te).otherwise(ts)
    tl3 = F.when(rev == 1, ts).otherwise(tl - te)
    e5, e3 = F.least(qs, tl5), F.least(ql - qe, tl3)
    qa, ta = qe - qs, te - ts
    inner = (e5 > max_hang) | (e3 > max_hang) | (qa < rate * (qa + e5 + e3)) | (ta < rate * (ta + e5 + e3))
    qcont = (qs <= tl5) & (ql - qe <= tl3)
    tcont = (qs >= tl5) & (ql - qe >= tl3)
    fwd = qs > tl5
    short = (qa + e5 + e3 < min_ovlp) | (ta + e5 + e3 < min_ovlp)
    kind = F.when(inner, "INT").when(qcont, "QCONT").when(tcont, "TCONT").when(short, "SHORT").otherwise("ARC")
    u = qn * 2 + F.when(fwd, 0).otherwise(1)
    v = tn * 2 + F.when(fwd, rev).otherwise(1 - rev)
    length = F.when(fwd, qs - tl5).otherwise(ql - qe - tl3)
    is_arc = kind == "ARC"
    return F.struct(kind.alias("kind"), F.when(is_arc, u).alias("u"), F.when(is_arc, v).alias("v"), F.when(is_arc, length).alias("len"), F.when(is_arc, ql - length).alias("ol"))


def extended_interval(xs: Column, xe: Column, xl: Column, ys: Column, ye: Column, yl: Column) -> Column:
    """An anchored pair of intervals pushed to the nearer sequence ends: struct(xs, xe, ys, ye)."""
    a, b = F.least(xs, ys), F.least(xl - xe, yl - ye)
    return F.struct((xs - a).alias("xs"), (xe + b).alias("xe"), (ys - a).alias("ys"), (ye + b).alias("ye"))


def haplotig_class(xs: Column, xe: Column, xl: Column, ys: Column, ye: Column, yl: Column) -> Column:
    """YCX (x lies in y), XCY, X2Y or Y2X of an extended pair, tested in that order; XCY if none holds."""
    x_left, x_right, y_left, y_right = xs == 0, xe == xl, ys == 0, ye == yl
    return F.when(x_left & x_right, "YCX").when(y_left & y_right, "XCY").when(y_left & x_right, "X2Y").when(x_left & y_right, "Y2X").otherwise("XCY")


def trio_class(run_p: Column, run_m: Column, n_p: Column, n_m: Column, k: int = 31, ratio: float = 0.33) -> Column:
    """Parental class of a record from its longest runs and numbers of parent-specific k-mers: p, m, a (mixed) or 0.

    Without runs the counts decide: one parent must lead by k - 4 and the other have at most
    one k-mer or under 5 %. With runs, one parent's run must lead by k - 4 with the other's at
    most 5 % of it, and its k-mers must outweigh the other's by 1 / ratio; else it is mixed.
    """
    margin = k - 4

    def by_count(a: Column, b: Column) -> Column:
        return (a >= b + margin) & ((b <= 1) | (a * 0.05 > b))

    def by_run(ra: Column, rb: Column, a: Column, b: Column) -> Column:
        return (ra >= rb + margin) & (ra * 0.05 >= rb) & (a * ratio > b)

    no_run = F.when(by_count(n_p, n_m), "p").when(by_count(n_m, n_p), "m").otherwise("0")
    runs = F.when((run_p > k) & (run_m > k), "a").when(by_run(run_p, run_m, n_p, n_m), "p").when(by_run(run_m, run_p, n_m, n_p), "m").otherwise("a")
    return F.when((run_p == 0) & (run_m == 0), no_run).otherwise(runs)


def interval_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection of two half-open intervals."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def transfer_offset(off: Column, length: Column, target: Column) -> Column:
    """Proportional place of an offset on another length."""
    return F.floor(off * target / length).cast("long")


def seed_weight(n: Column, hom: int) -> Column:
    """Weight class of a seed with n occurrences: 1 near the coverage, 2 below it, growing above."""
    lo, hi = max(2, int(0.333 * hom)), int(1.667 * hom)
    many = F.floor(F.pow(1 + F.ceil(n / (2 * hi)), F.lit(1.1))).cast("int")
    return F.when((n > lo) & (n < hi), 1).when(n <= lo, 2).otherwise(many)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))

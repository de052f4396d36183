"""Scalar functions and projections (SCA) over the sequence tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..kernels import random as rnd
from .common import OVERLAPS, READS, SEEDS, Registry, overlaps, reads, seeds, table

q = Registry()
_LEAST = 1_000_000


@q(f"WITH {READS} SELECT rid, translate(regexp_replace(seq, '[^ACGTU]', '4', 'g'), 'ACGTU', '01233') AS code, (len - length(regexp_replace(seq, '[^ACGT]', '', 'g')))::INTEGER AS n_other FROM reads")
def sca01_encode(spark, d):
    r = reads(spark, d)
    return r.select("rid", S.encode_bases(F.col("seq")).alias("code"), (F.col("len") - F.length(F.regexp_replace("seq", "[^ACGT]", ""))).alias("n_other"))


@q(f"WITH {READS} SELECT rid, substr(seq, 51, 60) AS part, reverse(translate(substr(seq, 51, 60), 'ACGT', 'TGCA')) AS part_rc FROM reads WHERE len >= 110")
def sca02_sub_region(spark, d):
    s, at, n = F.col("seq"), F.lit(50), F.lit(60)
    return reads(spark, d).where("len >= 110").select("rid", S.sub_region(s, at, n, F.lit(False)).alias("part"), S.sub_region(s, at, n, F.lit(True)).alias("part_rc"))


@q(f"WITH {READS} SELECT rid, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def sca03_revcomp(spark, d):
    return reads(spark, d).select("rid", S.reverse_complement(F.col("seq")).alias("rc"))


_BIN_CASE = "CASE WHEN v <= 10 THEN 0 WHEN v <= 20 THEN 1 WHEN v <= 30 THEN 2 ELSE 3 END"
_QUALS = f"{READS}, quals AS (SELECT rid, unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS v FROM reads WHERE qual IS NOT NULL)"


@q(f"WITH {_QUALS} SELECT rid, count_if({_BIN_CASE} = 0)::INTEGER AS bin0, count_if({_BIN_CASE} = 1)::INTEGER AS bin1, count_if({_BIN_CASE} = 2)::INTEGER AS bin2, count_if({_BIN_CASE} = 3)::INTEGER AS bin3 FROM quals GROUP BY rid")
def sca04_quality_bins(spark, d):
    b = reads(spark, d).where("qual is not null").select("rid", S.quality_bins(F.col("qual")).alias("b"))
    return b.select("rid", *[(F.length("b") - F.length(F.replace("b", F.lit(str(i)), F.lit("")))).alias(f"bin{i}") for i in range(4)])


@q(f"WITH {_QUALS} SELECT rid, sum(v)::BIGINT AS q_sum, count(*)::INTEGER AS n, sum(v) >= count(*) * 30 AS kept FROM quals GROUP BY rid")
def sca05_mean_quality(spark, d):
    t = reads(spark, d).where("qual is not null").select("rid", S.quality_sum(F.col("qual")).alias("q_sum"), F.length("qual").alias("n"))
    return t.withColumn("kept", F.col("q_sum") >= F.col("n") * 30)


def _sql_hash64(col: str, src: str, bits: int = 62) -> str:
    m = (1 << bits) - 1

    def shl(x, n):
        return f"(({x} & {m >> n}) << {n})"

    steps = [
        f"((({m} - k) + {shl('k', 21)}) & {m})", "xor(k, k >> 24)", f"((((k + {shl('k', 3)}) & {m}) + {shl('k', 8)}) & {m})", "xor(k, k >> 14)",
        f"((((k + {shl('k', 2)}) & {m}) + {shl('k', 4)}) & {m})", "xor(k, k >> 28)", f"((k + {shl('k', 31)}) & {m})",
    ]
    sql = f"SELECT *, {col}::BIGINT AS k FROM {src}"
    for s in steps:
        sql = f"SELECT * REPLACE ({s} AS k) FROM ({sql})"
    return sql


@q(f"SELECT DISTINCT x, k AS h FROM ({_sql_hash64('x', '(SELECT x FROM minimizers WHERE x IS NOT NULL)')})")
def sca06_hash64(spark, d):
    return table(spark, d, "minimizers").where("x is not null").select("x", S.hash64(F.col("x")).alias("h")).distinct()


_RC = "reverse(translate(k, 'ACGT', 'TGCA'))"


@q(f"WITH {READS}, w AS (SELECT rid, pos::INTEGER AS pos, substr(seq, pos::INTEGER + 1, 21) AS k FROM (SELECT rid, seq, unnest(range(0, greatest(len - 20, 0))) AS pos FROM reads)) SELECT rid, pos, CASE WHEN up THEN k ELSE rc END AS canon, NOT up AS flipped FROM (SELECT *, {_RC} AS rc, translate(k, 'ACGT', '0011') < translate({_RC}, 'ACGT', '0011') AS up FROM w WHERE NOT regexp_matches(k, '[^ACGT]'))")
def sca07_canonical(spark, d):
    """Every 21-mer on its canonical strand: the one whose plane of high bits (G and T) is the smaller number."""
    t = reads(spark, d).where("len > 20").select("rid", F.posexplode(F.expr("transform(sequence(1, len - 20), i -> substr(seq, i, 21))")).alias("pos", "k")).where("not (k rlike '[^ACGT]')")
    rc = S.reverse_complement(F.col("k"))
    up = F.translate("k", "ACGT", "0011") < F.translate(rc, "ACGT", "0011")
    return t.select("rid", "pos", F.when(up, F.col("k")).otherwise(rc).alias("canon"), (~up).alias("flipped"))


@q(f"WITH {READS} SELECT rid, regexp_replace(seq, '(A)A+|(C)C+|(G)G+|(T)T+', '\\1\\2\\3\\4', 'g') AS hpc FROM reads")
def sca08_hpc(spark, d):
    return reads(spark, d).select("rid", S.collapse_homopolymers(F.col("seq")).alias("hpc"))


_TYPE = "CASE WHEN qs = 0 AND qe = ql THEN 2 WHEN qs = 0 THEN 0 WHEN qe = ql THEN 1 ELSE 3 END"


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, qe, ts, te, {_TYPE} AS ov_type FROM ovl")
def sca09_overlap_type(spark, d):
    o = overlaps(spark, d)
    return o.select("qn", "tn", "qs", "qe", "ts", "te", S.overlap_type(F.col("qs"), F.col("qe"), F.col("ql")).alias("ov_type"))


#: The overlap-to-arc rule in SQL, over columns qn,ql,qs,qe,tn,tl,ts,te,rev.
ARC_SQL = """SELECT qn, tn, qs, qe, ts, te, kind, CASE WHEN kind = 'ARC' THEN qn * 2 + (1 - fwd) END AS u, CASE WHEN kind = 'ARC' THEN tn * 2 + CASE WHEN fwd = 1 THEN rev ELSE 1 - rev END END AS v,
CASE WHEN kind = 'ARC' THEN alen END AS len, CASE WHEN kind = 'ARC' THEN ql - alen END AS ol FROM (
SELECT *, CASE WHEN fwd = 1 THEN qs - tl5 ELSE ql - qe - tl3 END AS alen,
CASE WHEN e5 > 1000 OR e3 > 1000 OR qe - qs < 0.8 * (qe - qs + e5 + e3) OR te - ts < 0.8 * (te - ts + e5 + e3) THEN 'INT' WHEN qs <= tl5 AND ql - qe <= tl3 THEN 'QCONT' WHEN qs >= tl5 AND ql - qe >= tl3 THEN 'TCONT'
WHEN qe - qs + e5 + e3 < 50 OR te - ts + e5 + e3 < 50 THEN 'SHORT' ELSE 'ARC' END AS kind FROM (
SELECT *, least(qs, tl5) AS e5, least(ql - qe, tl3) AS e3, (qs > tl5)::INTEGER AS fwd FROM (
SELECT *, CASE WHEN rev = 1 THEN tl - te ELSE ts END AS tl5, CASE WHEN rev = 1 THEN ts ELSE tl - te END AS tl3 FROM {src})))"""


def arcs_of(o):
    c = {n: F.col(n) for n in ("qn", "tn", "qs", "qe", "ql", "ts", "te", "tl", "rev")}
    t = o.withColumn("a", S.arc_fields(c["qn"], c["tn"], c["qs"], c["qe"], c["ql"], c["ts"], c["te"], c["tl"], c["rev"]))
    return t.select("qn", "tn", "qs", "qe", "ts", "te", "a.kind", "a.u", "a.v", "a.len", "a.ol")


@q(f"WITH {OVERLAPS} " + ARC_SQL.format(src="ovl"))
def sca10_arc_class(spark, d):
    return arcs_of(overlaps(spark, d))


_EXT = "SELECT qn, tn, qs, ts, qs - least(qs, ts) AS xs, qe + least(ql - qe, tl - te) AS xe, ts - least(qs, ts) AS ys, te + least(ql - qe, tl - te) AS ye, ql, tl FROM ovl WHERE rev = 0"


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, ts, xs, xe, ys, ye, xe - xs AS n FROM ({_EXT})")
def sca11_extend(spark, d):
    return _extended(spark, d).select("qn", "tn", "qs", "ts", "xs", "xe", "ys", "ye", (F.col("xe") - F.col("xs")).alias("n"))


def _extended(spark, d):
    o = overlaps(spark, d).where("rev = 0")
    e = S.extended_interval(F.col("qs"), F.col("qe"), F.col("ql"), F.col("ts"), F.col("te"), F.col("tl"))
    return o.withColumn("e", e).select("qn", "tn", "qs", "ts", "ql", "tl", "e.*")


@q(f"""WITH {OVERLAPS} SELECT qn, tn, qs, ts, CASE WHEN xs = 0 AND xe = ql THEN 'YCX' WHEN ys = 0 AND ye = tl THEN 'XCY' WHEN ys = 0 AND xe = ql THEN 'X2Y' WHEN xs = 0 AND ye = tl THEN 'Y2X' ELSE 'XCY' END AS cls FROM ({_EXT})""")
def sca12_haplotig_class(spark, d):
    c = S.haplotig_class(F.col("xs"), F.col("xe"), F.col("ql"), F.col("ys"), F.col("ye"), F.col("tl"))
    return _extended(spark, d).select("qn", "tn", "qs", "ts", c.alias("cls"))


_PAIR = "SELECT a.qn, a.tn AS t1, b.tn AS t2, a.qs AS s1, a.qe AS e1, b.qs AS s2, b.qe AS e2, a.te - a.ts AS m1 FROM ovl a JOIN ovl b ON a.qn = b.qn AND a.tn < b.tn"


@q(f"WITH {OVERLAPS} SELECT qn, t1, t2, s1, e1, s2, e2, greatest(0, least(e1, e2) - greatest(s1, s2))::BIGINT AS common, floor((greatest(s1, s2) - s1) * m1 / (e1 - s1))::BIGINT AS moved FROM ({_PAIR}) WHERE greatest(s1, s2) < least(e1, e2)")
def sca14_intersection(spark, d):
    o = overlaps(spark, d)
    a = o.select("qn", F.col("tn").alias("t1"), F.col("qs").alias("s1"), F.col("qe").alias("e1"), (F.col("te") - F.col("ts")).alias("m1"))
    b = o.select("qn", F.col("tn").alias("t2"), F.col("qs").alias("s2"), F.col("qe").alias("e2"))
    j = a.join(b, "qn").where("t1 < t2 and greatest(s1, s2) < least(e1, e2)")
    common = S.interval_overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).cast("long")
    moved = S.transfer_offset(F.greatest("s1", "s2") - F.col("s1"), F.col("e1") - F.col("s1"), F.col("m1"))
    return j.select("qn", "t1", "t2", "s1", "e1", "s2", "e2", common.alias("common"), moved.alias("moved"))


@q(f"WITH {SEEDS}, s AS (SELECT *, toff - qoff AS diag, lag(toff - qoff) OVER w AS before FROM seeds WINDOW w AS (PARTITION BY qid, tid, rev ORDER BY qoff, toff, coalesce(cnt, -1))) SELECT qid, tid, rev, qoff, toff, diag - before AS shift FROM s WHERE diag <> before")
def sca18_gap_shifts(spark, d):
    w = Window.partitionBy("qid", "tid", "rev").orderBy("qoff", "toff", F.coalesce("cnt", F.lit(-1)))
    s = seeds(spark, d).withColumn("diag", F.col("toff") - F.col("qoff")).withColumn("before", F.lag("diag").over(w))
    return s.where("diag <> before").select("qid", "tid", "rev", "qoff", "toff", (F.col("diag") - F.col("before")).alias("shift"))


@q(f"WITH {READS}, h AS (SELECT rid, regexp_extract_all(seq, 'A{{5,}}|C{{5,}}|G{{5,}}|T{{5,}}') AS runs FROM reads) SELECT rid, len(runs)::INTEGER AS n_runs, coalesce(list_max(list_transform(runs, lambda x: length(x))), 0)::INTEGER AS longest FROM h")
def sca19_homopolymers(spark, d):
    runs = F.regexp_extract_all("seq", F.lit("(A{5,}|C{5,}|G{5,}|T{5,})"), F.lit(1))
    t = reads(spark, d).select("rid", runs.alias("runs"))
    return t.select("rid", F.size("runs").alias("n_runs"), F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0)).alias("longest"))


def _mod64(x: str) -> str:
    return f"({x}) % 18446744073709551616"


_Z0 = _mod64("rid::UHUGEINT + 11400714819323198485::UHUGEINT")
_MIX = [("z // 1073741824", 13787848793156543929), ("z // 134217728", 10723151780598845931)]
_SPLIT = f"SELECT rid, {_Z0} AS z FROM reads"
for _sh, _mul in _MIX:
    _SPLIT = f"SELECT rid, {_mod64(f'xor(z, {_sh}) * {_mul}::UHUGEINT')} AS z FROM ({_SPLIT})"


@q(f"WITH {READS} SELECT rid, (xor(z, z // 2147483648) // 2048)::DOUBLE / 9007199254740992.0 AS u FROM ({_SPLIT})")
def sca23_splitmix64(spark, d):
    """A replayable stream: the first draw for each record id as seed, as a double in [0, 1)."""

    @F.pandas_udf("double")
    def draw(seed: pd.Series) -> pd.Series:
        return pd.Series(rnd.first_doubles(seed.to_numpy()))

    return reads(spark, d).select("rid", draw("rid").alias("u"))


_EXACT = "CASE WHEN o.rev = 1 THEN reverse(translate(substr(t.seq, (o.ts + 1)::INTEGER, (o.te - o.ts)::INTEGER), 'ACGT', 'TGCA')) ELSE substr(t.seq, (o.ts + 1)::INTEGER, (o.te - o.ts)::INTEGER) END"


@q(f"WITH {OVERLAPS} SELECT o.qn, o.tn, o.qs, o.qe, o.ts, o.te, o.rev, substr(a.seq, (o.qs + 1)::INTEGER, (o.qe - o.qs)::INTEGER) = {_EXACT} AS el FROM ovl o JOIN reads a ON a.rid = o.qn JOIN reads t ON t.rid = o.tn")
def sca25_exact_span(spark, d):
    return exact_overlaps(spark, d).select("qn", "tn", "qs", "qe", "ts", "te", "rev", "el")


def spans(spark, d):
    """Overlaps with the text of both aligned spans, the target in query orientation: qseq, tseq."""
    o = overlaps(spark, d)
    r = reads(spark, d).select("rid", "seq")
    o = o.join(r.select(F.col("rid").alias("qn"), F.col("seq").alias("a")), "qn").join(r.select(F.col("rid").alias("tn"), F.col("seq").alias("b")), "tn")
    qseq = F.expr("substr(a, cast(qs + 1 as int), cast(qe - qs as int))")
    tseq = S.sub_region(F.col("b"), F.col("ts").cast("int"), (F.col("te") - F.col("ts")).cast("int"), F.col("rev") == 1)
    return o.withColumn("qseq", qseq).withColumn("tseq", tseq).drop("a", "b")


def exact_overlaps(spark, d):
    return spans(spark, d).withColumn("el", F.col("qseq") == F.col("tseq"))


SPANS = f"""{OVERLAPS}, spans AS (SELECT o.*, substr(a.seq, (o.qs + 1)::INTEGER, (o.qe - o.qs)::INTEGER) AS qseq, {_EXACT} AS tseq FROM ovl o JOIN reads a ON a.rid = o.qn JOIN reads t ON t.rid = o.tn)"""

QUERIES, SQL = q.queries, q.sql

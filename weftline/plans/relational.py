"""Joins, aggregations, windows, top-k and set operations (JOI, AGG, WIN, TOP, SET) over overlaps and seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import intervals as I
from .common import EDGES, OVERLAPS, READS, RUNS, SEEDS, Registry, edges, overlaps, reads, runs, seeds, table
from .scalar import _TYPE, SPANS, exact_overlaps

q = Registry()
c = F.col
def n_rows():
    return F.count(F.lit(1))


# --- joins ------------------------------------------------------------------


@q(f"WITH {READS}, {SEEDS} SELECT s.qid, s.tid, s.qoff, a.len AS qlen, b.len AS tlen FROM seeds s JOIN reads a ON a.rid = s.qid JOIN reads b ON b.rid = s.tid")
def joi01_index_probe(spark, d):
    r = reads(spark, d).select("rid", "len")
    s = seeds(spark, d).join(r.select(c("rid").alias("qid"), c("len").alias("qlen")), "qid")
    return s.join(r.select(c("rid").alias("tid"), c("len").alias("tlen")), "tid").select("qid", "tid", "qoff", "qlen", "tlen")


_TOL = "s.qid = o.qn AND s.tid = o.tn AND s.rev = o.rev AND s.qoff >= o.qs - 0.1 * (o.qe - o.qs) AND s.qoff < o.qe + 0.1 * (o.qe - o.qs)"


@q(f"WITH {OVERLAPS}, {SEEDS} SELECT s.qid, s.tid, s.rev, s.qoff, s.toff, o.qs, o.qe FROM seeds s JOIN ovl o ON {_TOL}")
def joi02_tolerant_merge(spark, d):
    s, o = seeds(spark, d).alias("s"), overlaps(spark, d).alias("o")
    return s.join(o, F.expr(_TOL)).selectExpr("s.qid", "s.tid", "s.rev", "s.qoff", "s.toff", "o.qs", "o.qe")


@q(f"WITH {OVERLAPS}, p AS (SELECT DISTINCT qn, tn FROM ovl WHERE qn <> tn) SELECT a.qn, a.tn, b.qn IS NOT NULL AS mutual FROM p a LEFT JOIN p b ON a.qn = b.tn AND a.tn = b.qn")
def joi03_reciprocal(spark, d):
    p = overlaps(spark, d).where("qn <> tn").select("qn", "tn").distinct()
    back = p.select(c("tn").alias("qn"), c("qn").alias("tn"), F.lit(True).alias("b"))
    return p.join(back, ["qn", "tn"], "left").select("qn", "tn", c("b").isNotNull().alias("mutual"))


@q(f"WITH {OVERLAPS}, one AS (SELECT qn, tn, max(ml) AS ml FROM ovl WHERE qn <> tn GROUP BY ALL) SELECT least(qn, tn) AS u, greatest(qn, tn) AS v, max(ml) AS w FROM one GROUP BY ALL HAVING count(*) = 2")
def joi04_symmetric(spark, d):
    one = overlaps(spark, d).where("qn <> tn").groupBy("qn", "tn").agg(F.max("ml").alias("ml"))
    return one.groupBy(F.least("qn", "tn").alias("u"), F.greatest("qn", "tn").alias("v")).agg(F.max("ml").alias("w"), n_rows().alias("k")).where("k = 2").drop("k")


_CONT = """held AS (SELECT qn AS rid, min(struct_pack(l := -tl, t := tn)).t AS box FROM ovl WHERE qn <> tn AND (tl > ql OR (tl = ql AND tn < qn)) AND qs - (CASE WHEN rev = 1 THEN tl - te ELSE ts END) <= 0 AND (ql - qe) - (CASE WHEN rev = 1 THEN ts ELSE tl - te END) <= 0 AND qe - qs >= 0.5 * ql GROUP BY qn)"""


def containers(o):
    """rid, box: contained records and the longest record that holds them."""
    tl5 = F.when(c("rev") == 1, c("tl") - c("te")).otherwise(c("ts"))
    tl3 = F.when(c("rev") == 1, c("ts")).otherwise(c("tl") - c("te"))
    inside = (c("qs") <= tl5) & (c("ql") - c("qe") <= tl3) & (c("qe") - c("qs") >= 0.5 * c("ql"))
    longer = (c("tl") > c("ql")) | ((c("tl") == c("ql")) & (c("tn") < c("qn")))
    t = o.where((c("qn") != c("tn")) & longer & inside)
    return t.groupBy(c("qn").alias("rid")).agg(F.min_by("tn", F.struct(-c("tl"), "tn")).alias("box"))


@q(f"WITH {OVERLAPS}, {_CONT}, moved AS (SELECT coalesce(a.box, o.qn) AS qn, coalesce(b.box, o.tn) AS tn FROM ovl o LEFT JOIN held a ON a.rid = o.qn LEFT JOIN held b ON b.rid = o.tn) SELECT qn, tn, count(*)::BIGINT AS n FROM moved WHERE qn <> tn GROUP BY qn, tn")
def joi05_redirect(spark, d):
    o = overlaps(spark, d)
    h = containers(o)
    t = o.select("qn", "tn").join(h.select(c("rid").alias("qn"), c("box").alias("qb")), "qn", "left").join(h.select(c("rid").alias("tn"), c("box").alias("tb")), "tn", "left")
    return t.select(F.coalesce("qb", "qn").alias("qn"), F.coalesce("tb", "tn").alias("tn")).where("qn <> tn").groupBy("qn", "tn").agg(n_rows().alias("n"))


@q(f"""WITH {OVERLAPS}, g AS (SELECT rid, run_id FROM (SELECT rid, min(run_id) AS run_id FROM kseq_reads WHERE rid IS NOT NULL GROUP BY rid)),
h AS (SELECT DISTINCT o.qn, a.run_id AS x, b.run_id AS y FROM ovl o JOIN g a ON a.rid = o.qn JOIN g b ON b.rid = o.tn WHERE a.run_id <> b.run_id), tot AS (SELECT run_id AS x, count(*)::BIGINT AS total FROM g GROUP BY 1)
SELECT x, y, count(DISTINCT qn)::BIGINT AS n_hit, total, round(count(DISTINCT qn) / total, 6) AS share FROM h JOIN tot USING (x) GROUP BY x, y, total""")
def joi06_similarity(spark, d):
    """Share of the records of group x with any match into group y (groups: runs)."""
    g = table(spark, d, "kseq_reads").where("rid is not null").groupBy("rid").agg(F.min("run_id").alias("run"))
    o = overlaps(spark, d).select("qn", "tn").distinct()
    h = o.join(g.select(c("rid").alias("qn"), c("run").alias("x")), "qn").join(g.select(c("rid").alias("tn"), c("run").alias("y")), "tn").where("x <> y")
    tot = g.groupBy(c("run").alias("x")).agg(n_rows().alias("total"))
    n = h.groupBy("x", "y").agg(F.countDistinct("qn").alias("n_hit"))
    return n.join(tot, "x").select("x", "y", "n_hit", "total", F.round(c("n_hit") / c("total"), 6).alias("share"))


_REGION = "region_t AS (SELECT rid, (k * 100)::BIGINT AS rs, least((k + 1) * 100, len)::BIGINT AS re, (k % 2)::INTEGER AS kind FROM (SELECT rid, len, unnest(range(0, (len + 99) // 100)) AS k FROM reads))"


def regions(spark, d, width=100):
    """Fixed tiles of every record with an alternating kind (the het / hom segments of the source method)."""
    r = reads(spark, d).select("rid", c("len").cast("long").alias("len"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("len") - 1) / width))))
    return r.select("rid", (c("k") * width).alias("rs"), F.least((c("k") + 1) * width, c("len")).alias("re"), (c("k") % 2).cast("int").alias("kind"))


@q(f"WITH {OVERLAPS}, {_REGION} SELECT o.qn, o.tn, o.qs, o.qe, o.ts, r.kind, sum(least(o.qe, r.re) - greatest(o.qs, r.rs))::BIGINT AS bases FROM ovl o JOIN region_t r ON r.rid = o.qn AND o.qs < r.re AND r.rs < o.qe GROUP BY ALL")
def joi07_interval_overlap(spark, d):
    o = overlaps(spark, d).select(c("qn").alias("rid"), "tn", "qs", "qe", "ts")
    j = I.overlap_join(o, regions(spark, d), "rid", "qs", "qe", "rs", "re")
    b = S.interval_overlap(c("qs"), c("qe"), c("rs"), c("re"))
    return j.groupBy(c("rid").alias("qn"), "tn", "qs", "qe", "ts", "kind").agg(F.sum(b).cast("long").alias("bases"))


@q(f"WITH {OVERLAPS}, {SEEDS}, m AS (SELECT DISTINCT s.qid, s.qoff, o.tn, o.qs FROM seeds s JOIN ovl o ON o.qn = s.qid AND s.qoff >= o.qs AND s.qoff < o.qe) SELECT qid, qoff, tn FROM (SELECT *, row_number() OVER (PARTITION BY qid, qoff ORDER BY qs, tn) AS k FROM m) WHERE k = 1")
def joi08_point_in_interval(spark, d):
    """Each seed place with the first match, in order of start, that holds it."""
    s = seeds(spark, d).select(c("qid").alias("rid"), "qoff").distinct()
    o = overlaps(spark, d).select(c("qn").alias("rid"), "qs", "qe", "tn")
    j = I.point_join(s, o, "rid", "qoff", "qs", "qe")
    return j.groupBy(c("rid").alias("qid"), "qoff").agg(F.min_by("tn", F.struct("qs", "tn")).alias("tn"))


_PLACE = "place AS (SELECT DISTINCT qn AS rid, tn AS uid, ts FROM ovl WHERE qn <> tn), single AS (SELECT rid, count(*) = 1 AS one FROM place GROUP BY rid)"
_LINKED = "linked AS (SELECT u, v FROM edges WHERE w >= 150)"


@q(f"WITH {EDGES}, {_PLACE}, {_LINKED} SELECT l.u, l.v, a.uid AS u_at, b.uid AS v_at, a.ts AS u_pos, b.ts AS v_pos, (x.one AND y.one) AS sure FROM linked l JOIN place a ON a.rid = l.u JOIN place b ON b.rid = l.v JOIN single x ON x.rid = l.u JOIN single y ON y.rid = l.v")
def joi09_lift_over(spark, d):
    """Links lifted to all placements of both ends; sure only if both are placed once."""
    place = overlaps(spark, d).where("qn <> tn").select(c("qn").alias("rid"), c("tn").alias("uid"), "ts").distinct()
    place = place.withColumn("one", F.count(F.lit(1)).over(Window.partitionBy("rid")) == 1)
    e = edges(spark, d).where("w >= 150").select("u", "v")
    a = place.select(c("rid").alias("u"), c("uid").alias("u_at"), c("ts").alias("u_pos"), c("one").alias("o1"))
    b = place.select(c("rid").alias("v"), c("uid").alias("v_at"), c("ts").alias("v_pos"), c("one").alias("o2"))
    return e.join(a, "u").join(b, "v").select("u", "v", "u_at", "v_at", "u_pos", "v_pos", (c("o1") & c("o2")).alias("sure"))


@q(f"WITH {OVERLAPS}, {_REGION} SELECT o.qn, o.tn, o.qs, o.ts, o.te, r.rs, (o.ts + (greatest(o.qs, r.rs) - o.qs) * (o.te - o.ts) // (o.qe - o.qs))::BIGINT AS to_s, (o.ts + (least(o.qe, r.re) - o.qs) * (o.te - o.ts) // (o.qe - o.qs))::BIGINT AS to_e FROM ovl o JOIN region_t r ON r.rid = o.qn AND o.qs < r.re AND r.rs < o.qe WHERE o.rev = 0 AND o.qe > o.qs")
def joi10_interval_lift(spark, d):
    o = overlaps(spark, d).where("rev = 0 and qe > qs").select(c("qn").alias("rid"), "tn", "qs", "qe", "ts", "te")
    j = I.overlap_join(o, regions(spark, d), "rid", "qs", "qe", "rs", "re")
    lift = lambda at: c("ts") + S.transfer_offset(at - c("qs"), c("qe") - c("qs"), c("te") - c("ts"))
    return j.select(c("rid").alias("qn"), "tn", "qs", "ts", "te", "rs", lift(F.greatest("qs", "rs")).alias("to_s"), lift(F.least("qe", "re")).alias("to_e"))


_SWEEP = """ev AS (SELECT qn AS rid, pos, sum(x)::BIGINT AS x FROM (SELECT qn, qs AS pos, 1 AS x FROM ovl WHERE qs < qe UNION ALL SELECT qn, qe, -1 FROM ovl WHERE qs < qe) GROUP BY 1, 2),
depth AS (SELECT * FROM (SELECT rid, pos AS s, lead(pos) OVER w AS e, (sum(x) OVER w)::BIGINT AS depth FROM ev WINDOW w AS (PARTITION BY rid ORDER BY pos)) WHERE e IS NOT NULL)"""


def depth(spark, d):
    return I.depth_sweep(overlaps(spark, d).select(c("qn").alias("rid"), "qs", "qe"), "rid", "qs", "qe")


@q(f"WITH {OVERLAPS}, {_SWEEP}, {SEEDS} SELECT DISTINCT s.qid, s.qoff, p.depth FROM seeds s JOIN depth p ON p.rid = s.qid AND s.qoff >= p.s AND s.qoff < p.e")
def joi11_depth_lookup(spark, d):
    s = seeds(spark, d).select(c("qid").alias("rid"), "qoff").distinct()
    return I.point_join(s, depth(spark, d), "rid", "qoff", "s", "e").select(c("rid").alias("qid"), "qoff", "depth")


# --- aggregations -----------------------------------------------------------


@q(f"WITH {SPANS} SELECT qn AS rid, max(ql) AS len, (sum(CASE WHEN qseq = tseq THEN qe - qs ELSE 0 END) // max(ql))::BIGINT AS depth FROM spans WHERE qn <> tn GROUP BY qn")
def agg09_read_depth(spark, d):
    e = exact_overlaps(spark, d).where("qn <> tn")
    return e.groupBy(c("qn").alias("rid")).agg(F.max("ql").alias("len"), F.expr("sum(case when el then qe - qs else 0 end) div max(ql)").alias("depth"))


@q(f"WITH {OVERLAPS}, {_SWEEP} SELECT rid, s, e, depth FROM depth")
def agg10_depth_sweep(spark, d):
    return depth(spark, d)


_TRIM = "ovl_in AS (SELECT qn AS qn, CASE WHEN qs > 0 THEN qs + 16 ELSE qs END AS qs, CASE WHEN qe < ql THEN qe - 16 ELSE qe END AS qe, ql FROM ovl WHERE qn <> tn)"


@q(f"""WITH {OVERLAPS}, {_TRIM}, ev AS (SELECT qn AS rid, pos, sum(x)::BIGINT AS x FROM (SELECT qn, qs AS pos, 1 AS x FROM ovl_in WHERE qs < qe UNION ALL SELECT qn, qe, -1 FROM ovl_in WHERE qs < qe
UNION ALL SELECT DISTINCT qn, 0, 0 FROM ovl_in UNION ALL SELECT DISTINCT qn, ql, 0 FROM ovl_in) GROUP BY 1, 2), dp AS (SELECT rid, pos AS s, lead(pos) OVER w AS e, (sum(x) OVER w)::BIGINT AS depth FROM ev WINDOW w AS (PARTITION BY rid ORDER BY pos))
SELECT rid, min(depth) AS min_depth, min(depth) <= 1 AS chimeric FROM dp WHERE e IS NOT NULL GROUP BY rid""")
def agg11_min_depth(spark, d):
    """Least depth inside a record, ends included, with 16 letters trimmed off match ends that are not record ends; 1 or less marks a chimera."""
    o = overlaps(spark, d).where("qn <> tn")
    t = o.select(c("qn").alias("rid"), F.when(c("qs") > 0, c("qs") + 16).otherwise(c("qs")).alias("s"), F.when(c("qe") < c("ql"), c("qe") - 16).otherwise(c("qe")).alias("e"), "ql")
    live = t.where("s < e")
    ev = live.select("rid", c("s").alias("pos"), F.lit(1).alias("x")).unionByName(live.select("rid", c("e").alias("pos"), F.lit(-1).alias("x")))
    ends = t.select("rid", "ql").distinct()
    ev = ev.unionByName(ends.select("rid", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("x"))).unionByName(ends.select("rid", c("ql").alias("pos"), F.lit(0).alias("x")))
    ev = ev.groupBy("rid", "pos").agg(F.sum("x").alias("x"))
    w = Window.partitionBy("rid").orderBy("pos")
    dp = ev.select("rid", F.lead("pos").over(w).alias("e"), F.sum("x").over(w).alias("depth")).where("e is not null")
    return dp.groupBy("rid").agg(F.min("depth").alias("min_depth")).withColumn("chimeric", c("min_depth") <= 1)


@q(f"WITH {SPANS} SELECT count(*)::BIGINT AS n, count_if(rev = 1)::BIGINT AS n_rev, count_if(qseq = tseq)::BIGINT AS n_exact, count_if(qn = tn)::BIGINT AS n_self, sum(qe - qs)::BIGINT AS bases, min(ml) AS ml_min, max(ml) AS ml_max FROM spans")
def agg12_overlap_stats(spark, d):
    e = exact_overlaps(spark, d)
    return e.agg(n_rows().alias("n"), F.count_if(c("rev") == 1).alias("n_rev"), F.count_if(c("el")).alias("n_exact"), F.count_if(c("qn") == c("tn")).alias("n_self"), F.sum(c("qe") - c("qs")).alias("bases"), F.min("ml").alias("ml_min"), F.max("ml").alias("ml_max"))


@q(f"WITH {EDGES} SELECT u, v, w, n FROM edges")
def agg17_edge_merge(spark, d):
    return edges(spark, d)


@q(f"WITH {READS} SELECT count(*)::BIGINT AS n, sum(len)::BIGINT AS total, max(len)::BIGINT AS longest, (SELECT min(len)::BIGINT FROM (SELECT len, sum(len) OVER (ORDER BY len DESC, rid) - len AS before FROM reads) WHERE before < (SELECT sum(len) FROM reads) / 2) AS n50 FROM reads")
def agg18_n50(spark, d):
    """N50 and totals. The running sum is over distinct lengths (bounded by the longest record), not over records."""
    r = reads(spark, d)
    by = r.groupBy("len").agg(n_rows().alias("k"), F.sum(c("len").cast("long")).alias("b"))
    tot = by.agg(F.sum("k").alias("n"), F.sum("b").alias("total"), F.max(c("len").cast("long")).alias("longest"))
    run = by.withColumn("before", F.sum("b").over(Window.orderBy(F.desc("len"))) - c("b"))
    n50 = run.join(F.broadcast(tot)).where("before < total / 2").agg(F.min(c("len").cast("long")).alias("n50"))
    return tot.join(F.broadcast(n50)).select("n", "total", "longest", "n50")


@q(f"""WITH {EDGES}, e AS (SELECT u, v, w FROM edges), b AS (SELECT u AS x, v AS y, w FROM e UNION ALL SELECT v, u, w FROM e),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS k FROM b) SELECT least(x, y) AS u, greatest(x, y) AS v, round(sum(20.0 / k), 6) AS w FROM r GROUP BY ALL""")
def agg19_link_weight(spark, d):
    """Link weight: 20 over the rank of the link at either end, added."""
    e = edges(spark, d)
    b = e.select(c("u").alias("x"), c("v").alias("y"), "w").unionByName(e.select(c("v").alias("x"), c("u").alias("y"), "w"))
    r = b.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y")))
    return r.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.round(F.sum(F.lit(20.0) / c("k")), 6).alias("w"))


@q(f"WITH {OVERLAPS}, t AS (SELECT qn, {_TYPE} AS ov, count(*) AS k FROM ovl GROUP BY ALL) SELECT qn, ov::INTEGER AS ov, k::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY k DESC, ov) AS r FROM t) WHERE r = 1")
def agg20_type_vote(spark, d):
    o = overlaps(spark, d).groupBy("qn", S.overlap_type(c("qs"), c("qe"), c("ql")).alias("ov")).agg(n_rows().alias("k"))
    best = F.max_by(F.struct("ov", "k"), F.struct("k", -c("ov"))).alias("b")
    return o.groupBy("qn").agg(best).select("qn", "b.ov", "b.k")


@q(f"WITH {EDGES}, {RUNS}, spin AS (SELECT rid, run, CASE WHEN place = 1 THEN 1 ELSE -1 END AS s FROM runs) SELECT a.run, sum(-a.s * b.s * w)::BIGINT AS score FROM edges JOIN spin a ON a.rid = u JOIN spin b ON b.rid = v GROUP BY a.run")
def agg21_cut_score(spark, d):
    """Score of a two-sided assignment, the largest run against the others, per run of the first record."""
    k = runs(spark, d).select("rid", "run", F.when(c("place") == 1, 1).otherwise(-1).alias("s"))
    e = edges(spark, d).join(k.select(c("rid").alias("u"), "run", c("s").alias("a")), "u").join(k.select(c("rid").alias("v"), c("s").alias("b")), "v")
    return e.groupBy("run").agg(F.sum(-c("a") * c("b") * c("w")).alias("score"))


# --- windows ----------------------------------------------------------------


@q(f"WITH {READS} SELECT rid, k::INTEGER AS k, (k * 375)::INTEGER AS s, least((k + 1) * 375, len)::INTEGER AS e FROM (SELECT rid, len, unnest(range(0, (len + 374) // 375)) AS k FROM reads)")
def win01_tiling(spark, d):
    r = reads(spark, d).select("rid", "len", F.posexplode(F.sequence(F.lit(0), c("len") - 1, F.lit(375))).alias("k", "s"))
    return r.select("rid", "k", "s", F.least(c("s") + 375, c("len")).alias("e"))


_MZP = "p AS (SELECT DISTINCT rid, pos FROM minimizers WHERE rid IS NOT NULL AND pos IS NOT NULL)"


@q(f"WITH {_MZP}, g AS (SELECT rid, pos, pos - lag(pos) OVER w AS before, lead(pos) OVER w - pos AS behind FROM p WINDOW w AS (PARTITION BY rid ORDER BY pos)) SELECT rid, pos FROM g WHERE coalesce(before, 0) <= 200 OR coalesce(behind, 0) <= 200")
def win06_gap_pruning(spark, d):
    """Places that are not cut off from both neighbours by more than 200 letters."""
    p = table(spark, d, "minimizers").where("rid is not null and pos is not null").select("rid", "pos").distinct()
    w = Window.partitionBy("rid").orderBy("pos")
    g = p.withColumn("before", c("pos") - F.lag("pos").over(w)).withColumn("behind", F.lead("pos").over(w) - c("pos"))
    return g.where("coalesce(before, 0) <= 200 or coalesce(behind, 0) <= 200").select("rid", "pos")


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, qe, ts, te, rev, ml FROM (SELECT *, row_number() OVER (PARTITION BY qn, tn ORDER BY ml DESC, qe - qs, qs, ts, qe, te, rev, bl) AS k FROM ovl) WHERE k = 1")
def win07_best_per_target(spark, d):
    w = Window.partitionBy("qn", "tn").orderBy(F.desc("ml"), c("qe") - c("qs"), "qs", "ts", "qe", "te", "rev", "bl")
    return overlaps(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("qn", "tn", "qs", "qe", "ts", "te", "rev", "ml")


_DEF = f"WITH {OVERLAPS}, {_SWEEP}, g AS (SELECT rid, s, e, CASE WHEN depth <= 2 THEN e - s ELSE s - e END AS gain FROM depth), p AS (SELECT *, sum(gain) OVER (PARTITION BY rid ORDER BY s) AS pre FROM g)"


@q(_DEF + ", m AS (SELECT rid, e, (pre - least(0, coalesce(min(pre) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS v FROM p) SELECT rid, max(v) AS deficit FROM m GROUP BY rid")
def win10_low_depth_segment(spark, d):
    """Largest surplus of low-depth letters (depth 2 or less) over others in any stretch of a record."""
    w = Window.partitionBy("rid").orderBy("s")
    p = depth(spark, d).withColumn("gain", F.when(c("depth") <= 2, c("e") - c("s")).otherwise(c("s") - c("e"))).withColumn("pre", F.sum("gain").over(w))
    low = F.least(F.lit(0), F.coalesce(F.min("pre").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return p.withColumn("v", c("pre") - low).groupBy("rid").agg(F.max("v").alias("deficit"))


@q(f"WITH {OVERLAPS}, t AS (SELECT qn, qs, qe, max(qe) OVER (PARTITION BY qn ORDER BY qs, qe, tn, ts, te, rev, ml, bl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ovl WHERE qn <> tn) SELECT qn, sum(greatest(0, qe - greatest(qs, coalesce(b, qs))))::BIGINT AS covered FROM t GROUP BY qn")
def win11_covered(spark, d):
    return I.union_length(overlaps(spark, d).where("qn <> tn"), "qn", "qs", "qe")


# --- top-k ------------------------------------------------------------------


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, qe, ts, te FROM ovl ORDER BY qn, tn, qs, qe, ts, te")
def top01_total_order(spark, d):
    return overlaps(spark, d).select("qn", "tn", "qs", "qe", "ts", "te").orderBy("qn", "tn", "qs", "qe", "ts", "te")


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, ts, ov, ml FROM (SELECT *, rank() OVER (PARTITION BY qn, ov ORDER BY ml DESC) AS k FROM (SELECT *, {_TYPE} AS ov FROM ovl)) WHERE k <= 2")
def top02_per_class_with_ties(spark, d):
    o = overlaps(spark, d).withColumn("ov", S.overlap_type(c("qs"), c("qe"), c("ql")))
    k = F.rank().over(Window.partitionBy("qn", "ov").orderBy(F.desc("ml")))
    return o.withColumn("k", k).where("k <= 2").select("qn", "tn", "qs", "ts", "ov", "ml")


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, cls, score FROM (SELECT *, row_number() OVER (PARTITION BY qn, tn ORDER BY cls, score DESC, qe - qs DESC, qs, ts, rev, te, ml) AS k FROM (SELECT *, CASE WHEN qseq = tseq THEN 1 ELSE 2 END AS cls, (qe - qs) - 12 * (bl - ml) AS score FROM spans)) WHERE k = 1")
def top03_best_chain(spark, d):
    """One match per target: exact before inexact, then span minus 12 per error, then span."""
    e = exact_overlaps(spark, d).withColumn("cls", F.when(c("el"), 1).otherwise(2)).withColumn("score", c("qe") - c("qs") - 12 * (c("bl") - c("ml")))
    w = Window.partitionBy("qn", "tn").orderBy("cls", F.desc("score"), F.desc(c("qe") - c("qs")), "qs", "ts", "rev", "te", "ml")
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("qn", "tn", "qs", "ts", "cls", "score")


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, ts, ml, k FROM (SELECT *, (row_number() OVER (PARTITION BY qn ORDER BY ml DESC, tn, qs, ts, qe, te, rev, bl))::INTEGER AS k FROM ovl) WHERE k <= 3")
def top04_bounded(spark, d):
    w = Window.partitionBy("qn").orderBy(F.desc("ml"), "tn", "qs", "ts", "qe", "te", "rev", "bl")
    return overlaps(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("qn", "tn", "qs", "ts", "ml", "k")


@q(f"WITH {OVERLAPS} SELECT qn, tn, qs, ts, ml FROM (SELECT *, max(ml) OVER (PARTITION BY qn) AS best FROM ovl) WHERE ml >= 0.8 * best")
def top05_secondary(spark, d):
    return overlaps(spark, d).withColumn("best", F.max("ml").over(Window.partitionBy("qn"))).where("ml >= 0.8 * best").select("qn", "tn", "qs", "ts", "ml")


_TOP6 = "max(qe) OVER (PARTITION BY qn, tn, rev ORDER BY qs, qe DESC, ts, te, ml, bl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@q(f"WITH {OVERLAPS} SELECT qn, tn, rev, qs, qe, ts, te FROM (SELECT *, {_TOP6} AS b FROM ovl) WHERE b IS NULL OR qe > b")
def top06_not_nested(spark, d):
    w = Window.partitionBy("qn", "tn", "rev").orderBy("qs", F.desc("qe"), "ts", "te", "ml", "bl").rowsBetween(Window.unboundedPreceding, -1)
    return overlaps(spark, d).withColumn("b", F.max("qe").over(w)).where("b is null or qe > b").select("qn", "tn", "rev", "qs", "qe", "ts", "te")


@q(f"WITH {EDGES}, b AS (SELECT u AS x, v AS y, w FROM edges UNION ALL SELECT v, u, w FROM edges) SELECT x, y, w FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS k FROM b) WHERE k = 1")
def top07_argmax(spark, d):
    e = edges(spark, d)
    b = e.select(c("u").alias("x"), c("v").alias("y"), "w").unionByName(e.select(c("v").alias("x"), c("u").alias("y"), "w"))
    return b.groupBy("x").agg(F.max_by(F.struct("y", "w"), F.struct("w", -c("y"))).alias("b")).select("x", "b.y", "b.w")


# --- sets -------------------------------------------------------------------


@q("WITH a AS (SELECT DISTINCT rid FROM kseq_reads WHERE rid IS NOT NULL), m AS (SELECT max(rid) + 1 AS n FROM a) SELECT rid, 0 AS part FROM a UNION ALL SELECT rid + n, 1 FROM control_reads, m")
def set01_shifted_union(spark, d):
    """Two stored runs under one id space: ids of the second are shifted past the first."""
    a = table(spark, d, "kseq_reads").where("rid is not null").select("rid").distinct()
    m = a.agg((F.max("rid") + 1).alias("n"))
    b = table(spark, d, "control_reads").select("rid").join(F.broadcast(m))
    return a.withColumn("part", F.lit(0)).unionByName(b.select((c("rid") + c("n")).alias("rid"), F.lit(1).alias("part")))


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, CASE WHEN qseq = tseq AND rev = 0 THEN 'reverse' WHEN qseq = tseq THEN 'source' ELSE 'reverse' END AS kind FROM spans")
def set02_move_kind(spark, d):
    """Matches on the same strand move from the cis set to the trans set, by a change of kind."""
    e = exact_overlaps(spark, d).withColumn("kind", F.when(c("el"), "source").otherwise("reverse"))
    return e.select("qn", "tn", "qs", "ts", F.when(c("rev") == 0, "reverse").otherwise(c("kind")).alias("kind"))


@q(f"WITH {OVERLAPS}, p AS (SELECT DISTINCT qn, tn FROM ovl WHERE qn <> tn) SELECT qn, tn FROM p WHERE EXISTS (SELECT 1 FROM p o WHERE o.qn = p.tn AND o.tn = p.qn)")
def set03_symmetric_distinct(spark, d):
    p = overlaps(spark, d).where("qn <> tn").select("qn", "tn").distinct()
    return p.join(p.select(c("tn").alias("qn"), c("qn").alias("tn")), ["qn", "tn"], "left_semi")


_MASK = "mask AS (SELECT rid, bit_or(1 << (hash_bucket)) AS m FROM (SELECT rid, (x % 3)::INTEGER AS hash_bucket FROM minimizers WHERE x IS NOT NULL AND rid IS NOT NULL) GROUP BY rid)"


@q(f"WITH {EDGES}, {_MASK} SELECT u, v, (a.m & b.m)::INTEGER AS both, bit_count((a.m & b.m))::INTEGER AS n FROM edges JOIN mask a ON a.rid = u JOIN mask b ON b.rid = v WHERE a.m & b.m <> 0")
def set04_mask_intersection(spark, d):
    """Haplotype bit masks (here three classes of minimizers) that two linked records share."""
    mz = table(spark, d, "minimizers").where("x is not null and rid is not null")
    m = mz.groupBy("rid").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (c("x") % 3).cast("int"))).alias("m"))
    e = edges(spark, d).join(m.select(c("rid").alias("u"), c("m").alias("m1")), "u").join(m.select(c("rid").alias("v"), c("m").alias("m2")), "v")
    e = e.withColumn("both", c("m1").bitwiseAND(c("m2")))
    return e.where("both <> 0").select("u", "v", "both", F.bit_count("both").alias("n"))


@q("SELECT k::INTEGER AS mask, bit_count(k::INTEGER)::INTEGER AS size FROM (SELECT unnest(range(0, 64)) AS k) WHERE bit_count(k::INTEGER) = 3")
def set05_subsets(spark, d):
    """All 3-subsets of 6 haplotypes as bit masks."""
    return spark.range(64).select(c("id").cast("int").alias("mask")).withColumn("size", F.bit_count("mask")).where("size = 3")


QUERIES, SQL = q.queries, q.sql

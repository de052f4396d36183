"""Further queries: phasing of matches, rescue, breaking, blocks and smaller rules of the method."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import graph as G
from ..operators import kmers as K
from ..scratch import Scratch
from .advanced import TRIO_CLASS, sca13_trio_class
from .common import OVERLAPS, READS, RUNS, SEEDS, Registry, overlaps, reads, runs, seeds, spread
from .graph import _ARCS, arcs
from .kmers import _ALL, KLEN, _HITS, placed, seed_hits
from .relational import _CONT, _SWEEP, containers, depth
from .scalar import ARC_SQL, _sql_hash64

q = Registry()
c = F.col
_OVL = OVERLAPS[len(READS) + 2 :]  # for texts that have the reads already


def classes(spark, d):
    """rid, cls of the records with a parental class, written once."""
    return Scratch(spark, "classes").table(sca13_trio_class(spark, d).where("cls in ('p', 'm')"), "classes")


_GAP, _SKIP, _BAND = 0.05, 0.0005, 0.05
_SCORE = f"""CASE WHEN dq <= 0 OR dt <= 0 OR (dd > 16 AND dd > {_BAND} * dq) THEN NULL ELSE least({KLEN}, lo) - CASE WHEN dd > 0 OR lo > {KLEN} THEN floor(least({_GAP} * dd, least({KLEN}, lo) * (dd / CAST(lo AS DOUBLE)) / {_BAND}) + {_SKIP} * lo) ELSE 0 END END"""


@q(f"""WITH {_HITS}, l AS (SELECT qid, tid, rev, qpos, tpos, qpos - lag(qpos) OVER w AS dq, (tpos - lag(tpos) OVER w) * (1 - 2 * rev) AS dt FROM hits WINDOW w AS (PARTITION BY qid, tid, rev ORDER BY qpos, tpos)),
p AS (SELECT *, abs(dt - dq) AS dd, least(dq, dt) AS lo FROM l WHERE dq > 0 AND dt > 0) SELECT qid, tid, rev, qpos, tpos, round(({_SCORE})::DOUBLE, 6) AS score FROM p""")
def sca22_pair_score(spark, d):
    """Score of each seed hit behind the one before it: span gained less gap and skip costs; null where they don't fit."""
    w = Window.partitionBy("qid", "tid", "rev").orderBy("qpos", "tpos")
    t = seed_hits(spark, d).withColumn("dq", c("qpos") - F.lag("qpos").over(w)).withColumn("dt", (c("tpos") - F.lag("tpos").over(w)) * (1 - 2 * c("rev")))
    t = t.where("dq > 0 and dt > 0").withColumn("dd", F.abs(c("dt") - c("dq"))).withColumn("lo", F.least("dq", "dt"))
    return t.select("qid", "tid", "rev", "qpos", "tpos", F.round(F.expr(_SCORE).cast("double"), 6).alias("score"))


@q(f"WITH {SEEDS} SELECT qid, tid, rev, count(*)::BIGINT AS n, min(qoff) AS q_lo, max(qoff) AS q_hi FROM seeds WHERE cnt BETWEEN 2 AND 200 GROUP BY qid, tid, rev HAVING count(DISTINCT qoff) >= 2")
def seed02_filtered(spark, d):
    """Candidates of the correction path: seeds in the middle of the count range, two places at least."""
    s = seeds(spark, d).where("cnt between 2 and 200").groupBy("qid", "tid", "rev")
    t = s.agg(F.count(F.lit(1)).alias("n"), F.min("qoff").alias("q_lo"), F.max("qoff").alias("q_hi"), F.countDistinct("qoff").alias("k"))
    return t.where("k >= 2").drop("k")


@q()
def kmr05_thinning(spark, d):
    """Minimizers thinned to about one in 400 letters a record, the rarest first, never nearer than half of that."""
    mz = placed(spark, d)
    n = mz.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))
    t = mz.join(n, "x").groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("cnt", "pos"))).alias("m"))  # a record's own minimizers

    @F.pandas_udf("array<int>")
    def run(pos: pd.Series) -> pd.Series:
        out = []
        for p in pos:
            kept: set[int] = set()
            cells: set[int] = set()
            for x in p:
                cell = int(x) // 200
                if not any(k in cells for k in (cell - 1, cell, cell + 1)):
                    kept.add(int(x))
                    cells.add(cell)
            out.append(sorted(kept))
        return pd.Series(out)

    return spread(t).select("rid", F.explode(run("m.pos")).alias("pos"))


_WIDE = f"{_ARCS}, wide AS (SELECT u, v, max(ol) AS ol FROM ({ARC_SQL.format(src='sym').replace('0.8 *', '0.15 *')}) WHERE kind = 'ARC' GROUP BY u, v)"


@q(f"WITH {_WIDE}, dead AS (SELECT node FROM deg WHERE n_out = 0) SELECT u, v, ol FROM wide SEMI JOIN dead ON dead.node = wide.u WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.u = wide.u AND a.v = wide.v)")
def gra12_rescue(spark, d):
    """Arcs under a looser hang rule that leave dead ends of the graph."""
    o = overlaps(spark, d).where("qn <> tn").drop("ml", "bl")
    swapped = o.select(c("tn").alias("qn"), c("tl").alias("ql"), c("ts").alias("qs"), c("te").alias("qe"), c("qn").alias("tn"), c("ql").alias("tl"), c("qs").alias("ts"), c("qe").alias("te"), "rev")
    f = S.arc_fields(*[c(n) for n in ("qn", "tn", "qs", "qe", "ql", "ts", "te", "tl", "rev")], rate=0.15)
    wide = o.unionByName(swapped).withColumn("a", f).where("a.kind = 'ARC'").groupBy("a.u", "a.v").agg(F.max("a.ol").alias("ol"))
    a = arcs(spark, d)
    dead = G.degrees(a).where("n_out = 0").select(c("node").alias("u"))
    return wide.join(dead, "u", "left_semi").join(a.select("u", "v"), ["u", "v"], "left_anti").select("u", "v", "ol")


@q(f"WITH {OVERLAPS} SELECT qn, tn, rev, min(qs) AS q_lo, max(qe) AS q_hi, min(ts) AS t_lo, max(te) AS t_hi, sum(ml)::BIGINT AS ml, count(*)::BIGINT AS n FROM ovl WHERE qn <> tn GROUP BY qn, tn, rev")
def pur02_boundaries(spark, d):
    o = overlaps(spark, d).where("qn <> tn").groupBy("qn", "tn", "rev")
    return o.agg(F.min("qs").alias("q_lo"), F.max("qe").alias("q_hi"), F.min("ts").alias("t_lo"), F.max("te").alias("t_hi"), F.sum("ml").alias("ml"), F.count(F.lit(1)).alias("n"))


@q(f"WITH {TRIO_CLASS}, k AS (SELECT rid, cls FROM cls WHERE cls IN ('p', 'm')), {_OVL} SELECT o.qn, o.tn, o.qs, o.ts FROM ovl o LEFT JOIN k a ON a.rid = o.qn LEFT JOIN k b ON b.rid = o.tn WHERE a.cls IS NULL OR b.cls IS NULL OR a.cls = b.cls")
def pha07_by_class(spark, d):
    """Matches between records of one parental class, or with a record of none."""
    k = classes(spark, d).hint("merge")
    o = overlaps(spark, d).join(k.select(c("rid").alias("qn"), c("cls").alias("a")), "qn", "left").join(k.select(c("rid").alias("tn"), c("cls").alias("b")), "tn", "left")
    return o.where("a is null or b is null or a = b").select("qn", "tn", "qs", "ts")


_UNI = f"{_ALL}, {RUNS}, once AS (SELECT kmer, min(rid) AS uid, min(pos) AS upos FROM kmers JOIN runs USING (rid) WHERE place = 1 GROUP BY kmer HAVING count(*) = 1)"


@q(f"WITH {_UNI} SELECT k.rid AS qid, o.uid, count(*)::BIGINT AS n, min(o.upos)::INTEGER AS first_pos FROM kmers k JOIN once o USING (kmer) LEFT JOIN runs r ON r.rid = k.rid WHERE coalesce(r.place, 0) <> 1 GROUP BY k.rid, o.uid HAVING count(*) >= 10")
def pha08_unique_hits(spark, d):
    """Records placed on contigs by k-mers that occur once there (contigs: the records of the largest run, mates: all others)."""
    r, contigs = reads(spark, d), runs(spark, d).where("place = 1").select("rid")
    p = K.kmer_positions(r.join(contigs, "rid", "left_semi"), KLEN)
    once = p.groupBy("code").agg(F.min("rid").alias("uid"), F.min("pos").alias("upos"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    once = Scratch(spark, "unique").table(once, "once")
    m = K.kmer_positions(r.join(contigs, "rid", "left_anti"), KLEN, only=K.code_filter(once)).select("code", c("rid").alias("qid"))
    h = m.join(once.hint("merge"), "code")
    return h.groupBy("qid", "uid").agg(F.count(F.lit(1)).alias("n"), F.min("upos").alias("first_pos")).where("n >= 10")


@q(f"WITH {OVERLAPS}, {_SWEEP} SELECT p.rid, s, e, depth FROM depth p JOIN reads r ON r.rid = p.rid WHERE depth <= 1 AND s > 0 AND e < r.len AND e - s >= 30")
def scf05_breaks(spark, d):
    """Inner stretches of 30 letters or more with depth 1 or less: where a contig would be broken."""
    t = depth(spark, d).where("depth <= 1 and s > 0 and e - s >= 30").join(reads(spark, d).select("rid", "len"), "rid")
    return t.where("e < len").select("rid", "s", "e", "depth")


@q(f"WITH {TRIO_CLASS}, {_OVL}, t AS (SELECT qn, k.cls AS h, lag(k.cls) OVER (PARTITION BY qn ORDER BY qs, qe, tn, ts, te, rev, ml, bl) AS b FROM ovl JOIN cls k ON k.rid = tn AND k.cls IN ('p', 'm') WHERE qn <> tn) SELECT qn, count(*)::BIGINT AS n, count_if(coalesce(h <> b, false))::BIGINT AS switches FROM t GROUP BY qn")
def scf06_switches(spark, d):
    """Changes of the parental class of the partners along a record; partners without a class are passed over."""
    w = Window.partitionBy("qn").orderBy("qs", "qe", "tn", "ts", "te", "rev", "ml", "bl")
    t = overlaps(spark, d).where("qn <> tn").join(classes(spark, d).hint("merge").select(c("rid").alias("tn"), c("cls").alias("h")), "tn").withColumn("b", F.lag("h").over(w))
    return t.groupBy("qn").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("h") != c("b")).alias("switches"))


@q(f"WITH {OVERLAPS}, b AS (SELECT qn AS rid, list(struct_pack(qs := qs, qe := qe, tn := tn, ts := ts, te := te, rev := rev) ORDER BY qs, qe, tn, ts, te, rev) AS blocks FROM (SELECT DISTINCT qn, qs, qe, tn, ts, te, rev FROM ovl WHERE qn <> tn) GROUP BY qn) SELECT rid, len(blocks)::INTEGER AS n_blocks, blocks[1].qs AS first_s, blocks[-1].qe AS last_e, list_sum(list_transform(blocks, lambda x: x.qe - x.qs))::BIGINT AS bases FROM b")
def uli01_blocks(spark, d):
    """A record as the ordered list of blocks that other records lend it."""
    o = overlaps(spark, d).where("qn <> tn").select("qn", F.struct("qs", "qe", "tn", "ts", "te", "rev").alias("b")).distinct()
    t = o.groupBy(c("qn").alias("rid")).agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    bases = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["qe"] - x["qs"])
    return t.select("rid", F.size("blocks").alias("n_blocks"), F.element_at("blocks", 1)["qs"].alias("first_s"), F.element_at("blocks", -1)["qe"].alias("last_e"), bases.alias("bases"))


@q(f"WITH {READS} SELECT rid, k AS h FROM ({_sql_hash64('rid', '(SELECT rid FROM reads)')}) ORDER BY h")
def top08_shuffle(spark, d):
    """A replayable shuffle: order by the invertible hash of the id."""
    return reads(spark, d).select("rid", S.hash64(c("rid")).alias("h")).orderBy("h")


@q(f"WITH {OVERLAPS}, {_CONT}, m AS (SELECT r.rid, r.len, coalesce(h.box, r.rid) AS uid FROM reads r LEFT JOIN held h USING (rid)), g AS (SELECT m.uid, count(DISTINCT o.qn)::BIGINT AS n_records, sum(qe - qs)::BIGINT AS bases, count_if(o.rev = 1)::BIGINT AS n_rev FROM ovl o JOIN m ON m.rid = o.qn WHERE o.qn <> o.tn GROUP BY m.uid), l AS (SELECT uid, sum(len)::BIGINT AS total FROM m GROUP BY uid) SELECT uid, n_records, n_rev, (bases // total)::BIGINT AS depth FROM g JOIN l USING (uid)")
def agg22_group_depth(spark, d):
    """Records, matches on the other strand and depth per group: a record and those that it holds."""
    o = overlaps(spark, d)
    m = reads(spark, d).select("rid", c("len").cast("long").alias("len")).join(containers(o), "rid", "left").select("rid", "len", F.coalesce("box", "rid").alias("uid"))
    g = o.where("qn <> tn").join(m.select(c("rid").alias("qn"), "uid"), "qn").groupBy("uid").agg(F.countDistinct("qn").alias("n_records"), F.sum(c("qe") - c("qs")).alias("bases"), F.count_if(c("rev") == 1).alias("n_rev"))
    return g.join(m.groupBy("uid").agg(F.sum("len").alias("total")), "uid").select("uid", "n_records", "n_rev", F.expr("bases div total").alias("depth"))


QUERIES, SQL = q.queries, q.sql

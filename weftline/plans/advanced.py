"""Alignment, chaining, consensus, parental classes, purging, phasing and scaffolding (ALN, WIN, ECC, PUR, PHA, SCF)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..kernels import align, chain, maxcut, scripts
from ..operators import graph as G
from ..operators import kmers as K
from ..options import Options
from .common import EDGES, OVERLAPS, READS, RUNS, Registry, edges, overlaps, reads, runs, spread
from .kmers import _ALL, KLEN, seed_hits
from .relational import _CONT, containers
from .relational import SQL as REL
from .scalar import SPANS, spans

q = Registry()
c = F.col

# --- alignment --------------------------------------------------------------


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, rev, CASE WHEN levenshtein(qseq, tseq) <= 12 THEN levenshtein(qseq, tseq)::INTEGER ELSE -1 END AS dist FROM spans")
def aln01_edit_distance(spark, d):
    return spans(spark, d).select("qn", "tn", "qs", "ts", "rev", F.levenshtein("qseq", "tseq", 12).alias("dist"))


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, rev, levenshtein(qseq, tseq)::INTEGER AS n_edit, true AS rebuilt FROM spans")
def aln02_trace(spark, d):
    """Edit scripts of all matches (ALN-02, SCA-16, SCA-17): errors, and whether applying the coded script gives the target."""

    @F.pandas_udf("n_edit int, rebuilt boolean")
    def run(a: pd.Series, b: pd.Series, dist: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, ops in zip(a, b, scripts.scripts(a.tolist(), b.tolist(), dist.tolist())):
            s = align.decode_script(align.encode_script(scripts.runs(ops)))
            out.append((align.errors(s), align.apply_script(x, y, s) == y))
        return pd.DataFrame(out, columns=["n_edit", "rebuilt"])

    t = spans(spark, d).withColumn("d", F.levenshtein("qseq", "tseq"))
    return t.withColumn("r", run("qseq", "tseq", "d")).select("qn", "tn", "qs", "ts", "rev", "r.n_edit", "r.rebuilt")


@q()
def aln03_semi_global(spark, d):
    """The whole query span placed in the target span, ends free."""

    @F.pandas_udf("dist int, s int, e int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.find(x, y) for x, y in zip(a, b)], columns=["dist", "s", "e"])

    return spread(spans(spark, d)).withColumn("r", run("qseq", "tseq")).select("qn", "tn", "qs", "ts", "rev", "r.dist", "r.s", "r.e")


@q()
def aln05_extension(spark, d):
    """Forward and backward extension of each match within 5 edits (ALN-05)."""

    @F.pandas_udf("f_q int, f_t int, b_q int, b_t int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            f, r = align.extend(x, y, 5), align.extend(x[::-1], y[::-1], 5)
            out.append((f[0], f[1], r[0], r[1]))
        return pd.DataFrame(out, columns=["f_q", "f_t", "b_q", "b_t"])

    return spread(spans(spark, d)).withColumn("r", run("qseq", "tseq")).select("qn", "tn", "qs", "ts", "rev", "r.*")


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, rev, list_sum(list_transform(range(1, length(qseq) + 1), lambda i: (qseq[i] <> tseq[i])::INTEGER))::INTEGER AS n_diff FROM spans WHERE length(qseq) = length(tseq) AND length(qseq) > 0")
def aln06_ungapped(spark, d):
    """Mismatches of spans of equal length, compared letter by letter over whole batches."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        n = a.str.len().to_numpy(np.int64)
        x, y = (np.frombuffer("".join(s).encode("latin1"), np.uint8) for s in (a, b))
        return pd.Series(np.add.reduceat((x != y).astype(np.int32), np.cumsum(n) - n)) if len(n) else pd.Series([], dtype="int32")

    t = spans(spark, d).where("length(qseq) = length(tseq) and length(qseq) > 0")
    return t.select("qn", "tn", "qs", "ts", "rev", run("qseq", "tseq").alias("n_diff"))


@q()
def aln07_affine(spark, d):
    @F.pandas_udf("score int, q_end int, t_end int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.affine(x, y) for x, y in zip(a, b)], columns=["score", "q_end", "t_end"])

    return spread(spans(spark, d)).withColumn("r", run("qseq", "tseq")).select("qn", "tn", "qs", "ts", "rev", "r.*")


_WIN = "SELECT qn, tn, qs, ts, rev, k::INTEGER AS k, substr(qseq, (k * 100 + 1)::INTEGER, 100) AS a, substr(tseq, (k * 100 * length(tseq) // length(qseq) + 1)::INTEGER, (least((k + 1) * 100, length(qseq)) * length(tseq) // length(qseq) - k * 100 * length(tseq) // length(qseq))::INTEGER) AS b FROM (SELECT *, unnest(range(0, (length(qseq) + 99) // 100)) AS k FROM spans WHERE length(qseq) > 0)"


@q(f"WITH {SPANS} SELECT qn, tn, qs, ts, rev, k, levenshtein(a, b)::INTEGER AS err FROM ({_WIN})")
def aln08_windows(spark, d):
    """Errors of each 100-letter window of a match against its proportional target window."""
    t = spans(spark, d).where("length(qseq) > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("(length(qseq) - 1) div 100"))))
    a = F.expr("substr(qseq, k * 100 + 1, 100)")
    lo, hi = "cast((k * 100 * length(tseq)) div length(qseq) as int)", "cast((least((k + 1) * 100, length(qseq)) * length(tseq)) div length(qseq) as int)"
    b = F.expr(f"substr(tseq, {lo} + 1, {hi} - {lo})")
    return t.select("qn", "tn", "qs", "ts", "rev", c("k").cast("int").alias("k"), F.levenshtein(a, b).alias("err"))


@q()
def aln10_longest_exact(spark, d):
    @F.pandas_udf("s int, n int")
    def run(a: pd.Series, b: pd.Series, dist: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.longest_exact(scripts.runs(o)) for o in scripts.scripts(a.tolist(), b.tolist(), dist.tolist())], columns=["s", "n"])

    t = spans(spark, d).withColumn("d", F.levenshtein("qseq", "tseq"))
    return t.withColumn("r", run("qseq", "tseq", "d")).select("qn", "tn", "qs", "ts", "rev", "r.*")


# --- chaining ---------------------------------------------------------------


def hit_lists(spark, d):
    """Seed hits of a pair and strand in one row, in order of query place; a pair has at most a record's minimizers."""
    h = seed_hits(spark, d).groupBy("qid", "tid", "rev").agg(F.sort_array(F.collect_list(F.struct("qpos", "tpos"))).alias("h"))
    return h.where("size(h) >= 2").select("qid", "tid", "rev", c("h.qpos").alias("qp"), c("h.tpos").alias("tp"))


CHAIN_ROWS = 40  # pairs with up to so many hits are chained together with all others of their size


@q()
def win02_chains(spark, d):
    """Best chain of every pair (WIN-02, WIN-03) and how many chains score half of it (WIN-04)."""

    @F.pandas_udf("score double, n int, q_lo int, q_hi int, t_lo int, t_hi int, n_chains int")
    def run(qp: pd.Series, tp: pd.Series, rev: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(qp), 7))
        size, back = qp.map(len).to_numpy(), rev.to_numpy() != 0
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for at in np.array_split(own, max(1, len(own) * n * n >> 18)) if n <= CHAIN_ROWS else own[:, None]:
                x, y = (np.stack(v.iloc[at].to_numpy()).astype(np.int64) for v in (qp, tp))
                z = np.where(back[at, None], -y, y)  # a reverse match is collinear once the target runs backwards
                if n <= CHAIN_ROWS:
                    score, on, k = chain.chains_of_many(x, z, 0.5)
                else:
                    got = chain.chains(x[0], z[0], np.ones(n, np.int64), 0.5)
                    score, on, k = got[0][0], np.isin(np.arange(n), got[0][1])[None], len(got)
                low, high = (lambda v: np.where(on, v, v.max()).min(1)), (lambda v: np.where(on, v, v.min()).max(1))  # noqa: B023
                out[at] = np.column_stack(np.broadcast_arrays(score, on.sum(1), low(x), high(x), low(y), high(y), k))
        return pd.DataFrame(out, columns=["score", "n", "q_lo", "q_hi", "t_lo", "t_hi", "n_chains"]).astype({x: "int32" for x in ("n", "q_lo", "q_hi", "t_lo", "t_hi", "n_chains")})

    return spread(hit_lists(spark, d)).withColumn("r", run("qp", "tp", "rev")).select("qid", "tid", "rev", "r.*")


@q()
def win08_increasing(spark, d):
    """Longest strictly increasing run of target places in query order, and the similarity by it (WIN-08, WIN-13)."""

    @F.pandas_udf("int")
    def run(tp: pd.Series, rev: pd.Series) -> pd.Series:
        return pd.Series([chain.increasing([-v for v in t] if r else list(t)) for t, r in zip(tp, rev)], dtype="int32")

    t = spread(hit_lists(spark, d)).select("qid", "tid", "rev", F.size("tp").alias("n"), run("tp", "rev").alias("lis"))
    return t.withColumn("weight", F.round(c("lis") - 0.2 * (c("n") - c("lis")), 6))


# --- strands and chimeras ----------------------------------------------------


@q(f"WITH {OVERLAPS} SELECT qn, tn, ql - qe AS qs, ql - qs AS qe, tl - te AS ts, tl - ts AS te, rev FROM ovl")
def ecc06_flip(spark, d):
    """All matches in the coordinates of the other strand."""
    return overlaps(spark, d).select("qn", "tn", (c("ql") - c("qe")).alias("qs"), (c("ql") - c("qs")).alias("qe"), (c("tl") - c("te")).alias("ts"), (c("tl") - c("ts")).alias("te"), "rev")


@q(f"WITH {OVERLAPS}, bad AS (SELECT rid FROM ({REL['agg11_min_depth']}) WHERE chimeric) SELECT qn, tn, qs, qe, ts, te FROM ovl WHERE qn NOT IN (SELECT rid FROM bad) AND tn NOT IN (SELECT rid FROM bad)")
def ecc09_chimera_filter(spark, d):
    """Matches without those of records whose inner depth drops to 1 or less: two anti-joins."""
    from .relational import agg11_min_depth

    bad = agg11_min_depth(spark, d).where("chimeric").select("rid")
    o = overlaps(spark, d)
    return o.join(bad.withColumnRenamed("rid", "qn"), "qn", "left_anti").join(bad.withColumnRenamed("rid", "tn"), "tn", "left_anti").select("qn", "tn", "qs", "qe", "ts", "te")


# --- parental classes -------------------------------------------------------

_FLAG = "CASE WHEN cnt >= 5 THEN 2 WHEN cnt >= 2 THEN 1 END"
_MARK = f"""{_ALL}, {RUNS}, pat AS (SELECT kmer, {_FLAG} AS p FROM (SELECT kmer, least(count(*), 1023) AS cnt FROM kmers JOIN runs USING (rid) WHERE place = 1 GROUP BY kmer) WHERE cnt >= 2), mat AS (SELECT kmer, {_FLAG} AS m FROM (SELECT kmer, least(count(*), 1023) AS cnt FROM kmers JOIN runs USING (rid) WHERE place = 2 GROUP BY kmer) WHERE cnt >= 2),
flags AS (SELECT kmer, coalesce(p, 0) AS p, coalesce(m, 0) AS m FROM pat FULL JOIN mat USING (kmer))"""


def parent_flags(spark, d):
    """code, p, m: k-mer classes of the two parental dumps (the records of the two largest runs): 2 frequent, 1 seen, 0 absent.

    Records of other runs are ruled out where they are read, before their letters are shuffled.
    """
    from ..scratch import Scratch

    own = Scratch(spark, "parents").table(runs(spark, d).where("place <= 2").select(c("rid").cast("long").alias("rid"), "place"), "rids")
    r = reads(spark, d, only=K.code_filter(own.select(c("rid").alias("code"))))

    def side(k: int, name: str):
        t = K.kmer_counts(r.join(own.where(c("place") == k).hint("merge"), "rid", "left_semi"), KLEN, saturate=K.PARENT_MAX).where("cnt >= 2")
        return t.select("code", F.when(c("cnt") >= 5, 2).otherwise(1).alias(name))

    return side(1, "p").join(side(2, "m"), "code", "full").select("code", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("m", F.lit(0)).alias("m"))


@q(f"WITH {_MARK} SELECT kmer, p, m, (p | (m << 2))::INTEGER AS flag FROM flags")
def src05_parent_flags(spark, d):
    f = parent_flags(spark, d).withColumn("flag", c("p").bitwiseOR(F.shiftleft("m", 2)))
    return f.select(K.decode(c("code"), KLEN).alias("kmer"), "p", "m", "flag")


_TRIO = f"""{_MARK}, hit AS (SELECT k.rid, k.pos, CASE WHEN f.p = 2 AND f.m = 0 THEN 1 WHEN f.m = 2 AND f.p = 0 THEN 2 ELSE 0 END AS typ FROM kmers k JOIN flags f USING (kmer)),
n AS (SELECT rid, count_if(typ = 1)::BIGINT AS n_p, count_if(typ = 2)::BIGINT AS n_m FROM hit GROUP BY rid),
g AS (SELECT rid, typ, pos - row_number() OVER (PARTITION BY rid, typ ORDER BY pos) AS g FROM hit WHERE typ > 0), r AS (SELECT rid, typ, count(*) AS len FROM g GROUP BY rid, typ, g HAVING count(*) >= {KLEN - 4}),
rr AS (SELECT rid, coalesce(sum(CASE WHEN typ = 1 THEN len END), 0)::BIGINT AS run_p, coalesce(sum(CASE WHEN typ = 2 THEN len END), 0)::BIGINT AS run_m FROM r GROUP BY rid),
trio AS (SELECT r.rid, coalesce(n_p, 0)::BIGINT AS n_p, coalesce(n_m, 0)::BIGINT AS n_m, coalesce(run_p, 0)::BIGINT AS run_p, coalesce(run_m, 0)::BIGINT AS run_m FROM reads r LEFT JOIN n USING (rid) LEFT JOIN rr USING (rid))"""


def trio_counts(spark, d):
    """Counters of every record. Only k-mers of one parent count, so the others are ruled out where they are read; what is left meets the flags by a shuffle."""
    from ..scratch import Scratch

    typ = F.when((c("p") == 2) & (c("m") == 0), 1).when((c("m") == 2) & (c("p") == 0), 2)
    own = Scratch(spark, "trio").table(parent_flags(spark, d).select("code", typ.alias("typ")).where("typ is not null"), "flags")
    pos = K.kmer_positions(reads(spark, d), KLEN, only=K.code_filter(own)).select("rid", "pos", "code")
    h = pos.join(own.hint("merge"), "code").select("rid", "pos", "typ").repartition("rid")
    g = h.withColumn("g", c("pos") - F.row_number().over(Window.partitionBy("rid", "typ").orderBy("pos")))
    r = g.groupBy("rid", "typ", "g").agg(F.count(F.lit(1)).alias("len"))  # a record's hits of one type are its runs
    long = c("len") >= KLEN - 4
    t = r.groupBy("rid").agg(*[F.sum(F.when((c("typ") == k) & x, c("len"))).alias(f"{n}_{s}") for n, x in (("n", F.lit(True)), ("run", long)) for k, s in ((1, "p"), (2, "m"))])
    every = reads(spark, d).select("rid").join(t.hint("merge"), "rid", "left")
    return every.select("rid", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_p", "n_m", "run_p", "run_m")])


@q(f"WITH {_TRIO} SELECT * FROM trio")
def agg16_trio_counts(spark, d):
    return trio_counts(spark, d)


_K4 = KLEN - 4


TRIO_CLASS = f"""{_TRIO}, cls AS (SELECT rid, CASE WHEN run_p = 0 AND run_m = 0 THEN CASE WHEN n_p >= n_m + {_K4} AND (n_m <= 1 OR n_p * 0.05 > n_m) THEN 'p' WHEN n_m >= n_p + {_K4} AND (n_p <= 1 OR n_m * 0.05 > n_p) THEN 'm' ELSE '0' END
WHEN run_p > {KLEN} AND run_m > {KLEN} THEN 'a' WHEN run_p >= run_m + {_K4} AND run_p * 0.05 >= run_m AND n_p * 0.33 > n_m THEN 'p' WHEN run_m >= run_p + {_K4} AND run_m * 0.05 >= run_p AND n_m * 0.33 > n_p THEN 'm' ELSE 'a' END AS cls FROM trio)"""


@q(f"WITH {TRIO_CLASS} SELECT rid, cls FROM cls")
def sca13_trio_class(spark, d):
    return trio_counts(spark, d).select("rid", S.trio_class(c("run_p"), c("run_m"), c("n_p"), c("n_m"), KLEN).alias("cls"))


_TOK = "(SELECT string_split(read_name, '/')[1] AS name, 1 AS flag FROM control_reads UNION ALL SELECT read_name, 2 FROM kseq_reads WHERE read_name IS NOT NULL GROUP BY read_name HAVING count(*) > 1)"


@q(f"WITH {READS}, l AS (SELECT name, max(flag)::INTEGER AS flag FROM {_TOK} GROUP BY name) SELECT r.rid, coalesce(l.flag, 0)::INTEGER AS trio_flag FROM reads r LEFT JOIN l ON l.name = r.name")
def src06_name_lists(spark, d):
    """Flags from name lists (the spiked names, the names delivered more than once); names that no record has are passed over, a later list wins."""
    from .common import table

    a = table(spark, d, "control_reads").select(F.element_at(F.split("read_name", "/"), 1).alias("name"), F.lit(1).alias("flag"))
    b = table(spark, d, "kseq_reads").where("read_name is not null").groupBy(c("read_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(2).alias("flag"))
    lists = a.unionByName(b).groupBy("name").agg(F.max("flag").alias("flag"))
    return reads(spark, d).join(lists, "name", "left").select("rid", F.coalesce("flag", F.lit(0)).alias("trio_flag"))


@q("SELECT rid, bit_or(1 << (try_cast(substr(run_id, 4) AS INTEGER) % 8))::INTEGER AS mask FROM kseq_reads WHERE rid IS NOT NULL AND run_id IS NOT NULL GROUP BY rid")
def src07_haplotype_masks(spark, d):
    from .common import table

    t = table(spark, d, "kseq_reads").where("rid is not null and run_id is not null")
    return t.groupBy("rid").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.expr("cast(try_cast(substr(run_id, 4) as int) % 8 as int)"))).alias("mask"))


# --- purging ----------------------------------------------------------------


@q(f"WITH {OVERLAPS}, {_CONT}, s AS (SELECT qn, tn, sum(ml)::BIGINT AS score FROM ovl WHERE qn <> tn GROUP BY ALL), b AS (SELECT *, max(score) OVER (PARTITION BY qn) AS best FROM s) SELECT h.rid, h.box, b.score FROM held h JOIN b ON b.qn = h.rid AND b.tn = h.box WHERE b.score >= 0.95 * b.best")
def pur03_contained_haplotigs(spark, d):
    """Contained records whose container has at least 95 % of their best score."""
    o = overlaps(spark, d)
    s = o.where("qn <> tn").groupBy("qn", "tn").agg(F.sum("ml").alias("score")).withColumn("best", F.max("score").over(Window.partitionBy("qn")))
    return containers(o).join(s.select(c("qn").alias("rid"), c("tn").alias("box"), "score", "best"), ["rid", "box"]).where("score >= 0.95 * best").select("rid", "box", "score")


@q(f"WITH {OVERLAPS}, f AS (SELECT qn, tn, max(ml) AS ml FROM ovl WHERE qn <> tn AND qe - qs >= 100 AND ml >= 0.75 * bl GROUP BY ALL) SELECT a.qn, a.tn, greatest(a.ml, b.ml) AS w FROM f a JOIN f b ON a.qn = b.tn AND a.tn = b.qn")
def pur04_reverse_consistent(spark, d):
    f = overlaps(spark, d).where("qn <> tn and qe - qs >= 100 and ml >= 0.75 * bl").groupBy("qn", "tn").agg(F.max("ml").alias("ml"))
    b = f.select(c("tn").alias("qn"), c("qn").alias("tn"), c("ml").alias("m2"))
    return f.join(b, ["qn", "tn"]).select("qn", "tn", F.greatest("ml", "m2").alias("w"))


# --- phasing ----------------------------------------------------------------

def signed_edges(spark, d):
    """Links with a sign: matches on opposite strands ask for opposite sides."""
    o = overlaps(spark, d).where("qn <> tn")
    return o.groupBy(F.least("qn", "tn").alias("u"), F.greatest("qn", "tn").alias("v")).agg(F.sum(F.when(c("rev") == 1, c("ml")).otherwise(-c("ml"))).cast("double").alias("w")).where("w <> 0")


def phase(e):
    """rid, group_id, spin of every node of the signed edges (u, v, w); components of any size by the same kernel."""
    from ..scratch import Scratch

    scratch = Scratch(e.sparkSession, "phase")
    e = scratch.table(e, "edges")
    comp = scratch.table(G.components(e), "components")
    e = e.join(comp.select(c("rid").alias("u"), "group_id"), "u").select("group_id", "u", "v", "w")
    o = Options()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["u", "v"])  # rows of a group come in any order; the draws are replayable
        ids = np.unique(np.concatenate([t["u"], t["v"]]))
        s = maxcut.solve(len(ids), np.searchsorted(ids, t["u"]), np.searchsorted(ids, t["v"]), t["w"].to_numpy(), o.seed, o.perturb, o.perturb_rate)
        return pd.DataFrame({"rid": ids, "group_id": t["group_id"].iloc[0], "spin": s.astype(np.int32)})

    return e.groupBy("group_id").applyInPandas(run, "rid long, group_id long, spin int")


@q()
def pha01_max_cut(spark, d):
    return phase(signed_edges(spark, d))


@q()
def pha06_flags(spark, d):
    """Spins written back as flags: 1 one side, 2 the other, 0 where the cut says nothing."""
    s = phase(signed_edges(spark, d)).select("rid", "spin")
    return reads(spark, d).select("rid").join(s, "rid", "left").select("rid", F.when(c("spin") > 0, 1).when(c("spin") < 0, 2).otherwise(0).alias("flag"))


# --- scaffolding ------------------------------------------------------------

_BOTH = "b AS (SELECT u AS x, v AS y, w::DOUBLE AS w FROM edges UNION ALL SELECT v, u, w::DOUBLE FROM edges)"
_NW = f"{EDGES}, {_BOTH}, o AS (SELECT x, y, w, (SELECT max(w) FROM b k WHERE k.x = b.x AND k.y <> b.y) AS alt FROM b), nw AS (SELECT least(x, y) AS u, greatest(x, y) AS v, max(w) AS w, round(max(w) / coalesce(max(alt), 1), 6) AS nw FROM o GROUP BY ALL)"


def normalised(spark, d):
    """u, v, w, nw: weight over the best competing weight at either end (1 if there is none)."""
    e = edges(spark, d)
    b = e.select(c("u").alias("x"), c("v").alias("y"), c("w").cast("double").alias("w")).unionByName(e.select(c("v").alias("x"), c("u").alias("y"), c("w").cast("double").alias("w")))
    k = Window.partitionBy("x").orderBy(F.desc("w"), "y")
    b = b.withColumn("r", F.row_number().over(k)).withColumn("first", F.first("w").over(k)).withColumn("second", F.nth_value("w", 2).over(k.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    b = b.withColumn("alt", F.when(c("r") == 1, c("second")).otherwise(c("first")))
    return b.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.max("w").alias("w"), F.round(F.max("w") / F.coalesce(F.max("alt"), F.lit(1.0)), 6).alias("nw"))


@q(f"WITH {_NW} SELECT * FROM nw")
def scf01_normalised_links(spark, d):
    return normalised(spark, d)


@q(f"WITH {_NW}, m AS (SELECT u AS x, v AS y, nw FROM nw UNION ALL SELECT v, u, nw FROM nw), t AS (SELECT x, y, nw FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY nw DESC, y) AS k FROM m) WHERE k = 1) SELECT least(a.x, a.y) AS u, greatest(a.x, a.y) AS v, max(a.nw) AS nw FROM t a JOIN t b ON a.x = b.y AND a.y = b.x GROUP BY ALL")
def scf02_best_buddies(spark, d):
    """Links that are the best of both their ends."""
    n = normalised(spark, d).select("u", "v", "nw")
    m = n.select(c("u").alias("x"), c("v").alias("y"), "nw").unionByName(n.select(c("v").alias("x"), c("u").alias("y"), "nw"))
    t = m.groupBy("x").agg(F.max_by(F.struct("y", "nw"), F.struct("nw", -c("y"))).alias("b")).select("x", "b.y", "b.nw")
    return t.join(t.select(c("y").alias("x"), c("x").alias("y")), ["x", "y"]).groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.max("nw").alias("nw"))


_SCF4 = f"{EDGES}, pair AS (SELECT u, v FROM edges WHERE w >= 200)"


@q(f"WITH {_SCF4}, m AS (SELECT u AS sid, u AS rid FROM pair UNION SELECT u, v FROM pair) SELECT sid, count(*)::BIGINT AS n, length(string_agg(seq, repeat('N', 100) ORDER BY rid))::BIGINT AS len, md5(string_agg(seq, repeat('N', 100) ORDER BY rid)) AS digest FROM m JOIN reads USING (rid) GROUP BY sid")
def scf04_materialise(spark, d):
    """Members of a layout joined with 100 N between them (layouts here: a record and its heavy partners, in order of id)."""
    p = edges(spark, d).where("w >= 200")
    m = p.select(c("u").alias("sid"), c("u").alias("rid")).unionByName(p.select(c("u").alias("sid"), c("v").alias("rid"))).distinct()
    t = m.join(reads(spark, d).select("rid", "seq"), "rid").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("rid", "seq"))).alias("m"))
    text = F.array_join("m.seq", "N" * 100)
    return t.select("sid", F.size("m").cast("long").alias("n"), F.length(text).cast("long").alias("len"), F.md5(text).alias("digest"))


QUERIES, SQL = q.queries, q.sql

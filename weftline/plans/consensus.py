"""Votes, sites, phases and corrections over aligned matches, with letters changed, left out and added (AGG-13 to 15, SCA-20, ECC, SNK-07, SNK-10).

A match whose two spans differ by more than VOTE_DIFF of its length does not vote. The others
are aligned by their shortest edit script, and only differences travel: a column's depth comes
from a sweep over the intervals of the matches, what agrees is depth less differences, and no
row is made for a letter that agrees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..kernels import consensus, scripts
from ..operators import intervals as I
from ..scratch import Scratch
from ..sources import sinks as T
from .common import Registry, reads, spread
from .scalar import SPANS, spans

q = Registry()
c = F.col

#: Edits a letter of the query span that a voting match may have; spans of unrelated letters differ by about half.
VOTE_DIFF = 0.1
KEEP = "n < 3 or (m > 1 and m > 0.500001 * n and m > n - m)"

# A cell (i, j) lies on a shortest script if the distances before and behind it add up to the whole; the script taken is the
# one with the largest j in every row, so row i tells which target letters are used once i query letters are.
_CELLS = f"""{SPANS}, vp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY qn, tn, qs, qe, ts, te, rev) AS id, qn AS rid, tn, qs, qs + length(qseq) AS qe, ts, te, rev, qseq, tseq, d FROM (
SELECT *, levenshtein(qseq, tseq) AS d FROM (SELECT DISTINCT qn, tn, qs, qe, ts, te, rev, qseq, tseq FROM spans WHERE qn <> tn AND length(qseq) > 0)) WHERE d <= {VOTE_DIFF} * length(qseq)),
cell AS MATERIALIZED (SELECT id, i, unnest(range(greatest(i - d, 0), least(i + d, n) + 1))::INTEGER AS j FROM (SELECT id, d, length(tseq) AS n, unnest(range(0, length(qseq) + 1))::INTEGER AS i FROM vp WHERE d > 0)),
half AS MATERIALIZED (SELECT id, i, j, levenshtein(substr(qseq, 1, i), substr(tseq, 1, j)) AS v FROM cell JOIN vp USING (id)),
best AS MATERIALIZED (SELECT id, i, j, v FROM half JOIN vp USING (id) WHERE v + abs((length(qseq) - i) - (length(tseq) - j)) <= d AND v + levenshtein(substr(qseq, i + 1), substr(tseq, j + 1)) = d),
fr AS MATERIALIZED (SELECT id, i, max(j) AS j FROM best GROUP BY id, i),
step AS MATERIALIZED (SELECT p.id, p.rid, p.qs, c.i, a.j AS j0, c.j - a.j - (b.id IS NOT NULL)::INTEGER AS added, b.id IS NOT NULL AS paired, p.qseq[c.i] AS own, p.tseq[a.j + 1] AS other, p.tseq, c.i = length(p.qseq) AS last
FROM fr c JOIN fr a ON a.id = c.id AND a.i = c.i - 1 JOIN vp p ON p.id = c.id JOIN best x ON x.id = c.id AND x.i = a.i AND x.j = a.j LEFT JOIN best b ON b.id = c.id AND b.i = c.i AND b.j = a.j + 1 AND b.v = x.v + (p.qseq[c.i] <> p.tseq[a.j + 1])::INTEGER)"""
_COLS = f"""{_CELLS}, diffs AS MATERIALIZED (SELECT id, rid, qs + i - 1 AS col, own, CASE WHEN paired THEN other ELSE '-' END AS base FROM step WHERE NOT paired OR own <> other
UNION ALL SELECT id, rid, qs + i, '', '+' || substr(tseq, j0 + paired::INTEGER + 1, added) FROM step WHERE added > 0 AND NOT last),
votes AS (SELECT rid, col, own, base, count(*)::BIGINT AS n FROM diffs GROUP BY ALL),
cols AS (SELECT *, n - other AS m FROM (SELECT rid, col, own, sum(n) AS other, (SELECT count(*) FROM vp p WHERE p.rid = v.rid AND p.qs + (v.own = '')::INTEGER <= v.col AND v.col < p.qe) + 1 AS n FROM votes v GROUP BY rid, col, own)),
open_cols AS (SELECT rid, col, own, n, m FROM cols WHERE NOT ({KEEP})),
alt AS (SELECT rid, col, own, base AS alt, n AS occ1 FROM (SELECT *, row_number() OVER (PARTITION BY rid, col, own ORDER BY n DESC, base) AS k FROM votes) WHERE k = 1)"""
_SITES = f"{_COLS}, sites AS (SELECT rid, col, alt, m AS occ0, occ1, n AS total FROM alt JOIN cols USING (rid, col, own) WHERE own <> '' AND occ1 >= 2)"


def distance_within(share: float):
    """Edit distance of qseq and tseq, -1 where it surely exceeds ``share`` of the query: banded by powers of two of the length."""
    out = F.levenshtein("qseq", "tseq")
    for k in range(20, 4, -1):
        out = F.when(F.length("qseq") <= 1 << k, F.levenshtein("qseq", "tseq", int(share * (1 << k)))).otherwise(out)
    return out


def voting(spark, d):
    """Matches that vote, once each: rid, tn, qs, qe, ts, te, rev, both texts and their edit distance; written once."""
    # even partitions in front of the distance, which is the cost here; as a generated column it is worked out once
    t = spread(spans(spark, d).where("qn <> tn").select("qn", "tn", "qs", "ts", "te", "rev", "qseq", "tseq"))
    t = t.where("length(qseq) > 0").withColumn("d", F.explode(F.array(distance_within(VOTE_DIFF)))).where((c("d") >= 0) & (c("d") <= VOTE_DIFF * F.length("qseq")))
    t = t.select(c("qn").alias("rid"), "tn", "qs", (c("qs") + F.length("qseq")).alias("qe"), "ts", "te", "rev", "qseq", "tseq", "d").distinct()
    return Scratch(spark, "votes").table(t, "matches")


_KEY = ["rid", "tn", "qs", "qe", "ts", "te", "rev"]


def differences(m):
    """Every difference of every voting match: the match, col, own and base (a letter, ``-``, or ``+text`` before the column with an empty own)."""

    def run(batches):
        for b in batches:
            qseq, tseq, dist = (b.column(x).to_pylist() for x in ("qseq", "tseq", "d"))
            which, off, own, base = [], [], [], []
            for k, ops in enumerate(scripts.scripts(qseq, tseq, dist)):
                for i, a, x in scripts.differences(qseq[k], tseq[k], ops):
                    which.append(k)
                    off.append(i)
                    own.append(a)
                    base.append(x)
            at = pa.array(which, pa.int64())
            cols = [b.column(x).take(at) for x in _KEY]
            col = np.asarray(off, np.int64) + cols[2].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(col), pa.array(own, pa.string()), pa.array(base, pa.string())], names=[*_KEY, "col", "own", "base"])

    return m.where("d > 0").select(*_KEY, "qseq", "tseq", "d").mapInArrow(run, "rid long, tn long, qs long, qe long, ts long, te long, rev int, col long, own string, base string")


def votes(diff):
    """rid, col, own, base, n: other letters and gaps on a column, combined before the shuffle."""
    return diff.groupBy("rid", "col", "own", "base").agg(F.count(F.lit(1)).alias("n"))


def columns(m, v):
    """rid, col, own, n, m, alt, occ1 of every column with a difference: voters and agreeing ones, the record counted in both, and the other state seen most."""
    t = v.groupBy("rid", "col", "own").agg(F.sum("n").alias("other"), F.max_by(F.struct("base", "n"), F.struct("n", F.expr("transform(split(base, ''), x -> -ascii(x))"))).alias("b"))
    held = I.depth_sweep(m, "rid", "qs", "qe").select("rid", c("s").alias("_s"), c("e").alias("_e"), "depth")
    # what lies before a column is held by the matches that cover both of its sides
    between = I.depth_sweep(m.withColumn("qs", c("qs") + 1), "rid", "qs", "qe").select("rid", c("s").alias("_s"), c("e").alias("_e"), "depth")
    j = I.point_join(t.where("own <> ''"), held, "rid", "col", "_s", "_e").unionByName(I.point_join(t.where("own = ''"), between, "rid", "col", "_s", "_e"))
    return j.select("rid", "col", "own", (c("depth") + 1).alias("n"), (c("depth") + 1 - c("other")).alias("m"), c("b.base").alias("alt"), c("b.n").alias("occ1"))


def open_columns(cols):
    """Columns (and places before one, with an empty own) whose own state does not win."""
    return cols.where(f"not ({KEEP})")


def _columns(spark, d):
    m = voting(spark, d)
    diff = differences(m)
    return m, diff, columns(m, votes(diff))


@q(f"WITH {_COLS} SELECT rid, col, own, n::BIGINT AS n, m::BIGINT AS m FROM open_cols")
def agg13_open_columns(spark, d):
    return open_columns(_columns(spark, d)[2]).select("rid", "col", "own", "n", "m")


@q(f"WITH {_COLS} SELECT rid, col, own, base, n FROM votes")
def agg13_votes(spark, d):
    """Every other letter, gap and addition with its votes."""
    return votes(differences(voting(spark, d)))


def sites(cols):
    """Columns with another state seen twice: rid, col, alt, occ0, occ1, total."""
    return cols.where("own <> '' and occ1 >= 2").select("rid", "col", "alt", c("m").alias("occ0"), "occ1", c("n").alias("total"))


def pileup(spark, d):
    m, diff, cols = _columns(spark, d)
    on = I.point_join(sites(cols).select("rid", "col", "alt"), m.select(*_KEY), "rid", "col", "qs", "qe")
    j = on.join(diff.where("own <> ''").select(*_KEY, "col", "base"), [*_KEY, "col"], "left")
    return j.select(*_KEY, "col", F.when(c("base").isNull(), 0).when(c("base") == c("alt"), 1).otherwise(2).alias("allele"))


_PILE = f"{_SITES}, pile AS (SELECT p.id, p.rid, s.col, p.tn, p.ts, p.rev, CASE WHEN x.base IS NULL THEN 0 WHEN x.base = s.alt THEN 1 ELSE 2 END AS allele FROM sites s JOIN vp p ON p.rid = s.rid AND p.qs <= s.col AND s.col < p.qe LEFT JOIN diffs x ON x.id = p.id AND x.col = s.col AND x.own <> '')"


@q(f"WITH {_PILE} SELECT rid, col, tn, ts, rev, allele FROM pile")
def agg14_pileup(spark, d):
    """Long pile-up of sites: 0 own letter, 1 the other state seen most, 2 any other; matches that do not cover a site have no row."""
    return pileup(spark, d).select("rid", "col", "tn", "ts", "rev", "allele")


@q(f"WITH {_PILE} SELECT rid, tn, ts, rev, n_sites, n_other, CASE WHEN n_other * 3 > n_sites THEN 2 ELSE 1 END AS is_match FROM (SELECT id, rid, tn, ts, rev, count(*)::BIGINT AS n_sites, count_if(allele > 0)::BIGINT AS n_other FROM pile GROUP BY ALL)")
def agg15_is_match(spark, d):
    """Cis (1) or trans (2) by the states at shared sites: trans if more than a third are not the record's own."""
    p = pileup(spark, d).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(c("allele") > 0).alias("n_other"))
    return p.select("rid", "tn", "ts", "rev", "n_sites", "n_other", F.when(c("n_other") * 3 > c("n_sites"), 2).otherwise(1).alias("is_match"))


@q(f"WITH {_SITES} SELECT rid, col, occ0::BIGINT AS occ0, occ1::BIGINT AS occ1, total::BIGINT AS total, least(occ0, occ1) / (occ0 + occ1) > 0.3 AS shared_site, (least(occ0, occ1) / (occ0 + occ1) >= 0.35 AND occ0 >= 4 AND total >= 10) AS single_site FROM sites")
def sca20_snp_sites(spark, d):
    """Sites with the share tests for shared and for single sites (SCA-20)."""
    t = sites(_columns(spark, d)[2])
    share = F.least("occ0", "occ1") / (c("occ0") + c("occ1"))
    return t.select("rid", "col", "occ0", "occ1", "total", (share > 0.3).alias("shared_site"), ((share >= 0.35) & (c("occ0") >= 4) & (c("total") >= 10)).alias("single_site"))


@q(f"WITH {_SITES} SELECT rid, count(*)::BIGINT AS n_het FROM sites WHERE least(occ0, occ1) / (occ0 + occ1) > 0.3 GROUP BY rid")
def snk10_het_counts(spark, d):
    return sca20_snp_sites(spark, d).where("shared_site").groupBy("rid").agg(F.count(F.lit(1)).alias("n_het"))


def corrected(seqs, fixes):
    """rid, seq, n_changed: records with their fixes (rid, col, own, alt) put in; ``-`` drops a letter, ``+text`` goes before it."""
    f = fixes.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("col", "alt"))).alias("f"))  # at most two entries a letter of the record

    @F.pandas_udf("string")
    def run(seq: pd.Series, cols: pd.Series, alts: pd.Series) -> pd.Series:
        out = []
        for s, at, x in zip(seq, cols, alts):
            letters = list(s)
            before = {}
            for i, b in zip(at, x):
                if b[0] == "+":
                    before[i] = b[1:]
                else:
                    letters[i] = "" if b == "-" else b
            for i, b in before.items():
                letters[i] = b + letters[i]
            out.append("".join(letters))
        return pd.Series(out)

    return seqs.join(f, "rid").select("rid", run("seq", "f.col", "f.alt").alias("seq"), F.size("f").alias("n_changed"))


_FIX = f"{_COLS}, fix AS (SELECT rid, col, own, alt FROM open_cols JOIN alt USING (rid, col, own))"


@q(f"""WITH {_FIX}, l AS (SELECT rid, (i - 1)::BIGINT AS col, seq[i] AS ch FROM (SELECT rid, seq, unnest(range(1, len + 1)) AS i FROM reads SEMI JOIN fix USING (rid)))
SELECT l.rid, string_agg(coalesce(substr(p.alt, 2), '') || CASE WHEN f.alt = '-' THEN '' ELSE coalesce(f.alt, l.ch) END, '' ORDER BY l.col) AS seq, (count(f.alt) + count(p.alt))::INTEGER AS n_changed
FROM l LEFT JOIN fix f ON f.rid = l.rid AND f.col = l.col AND f.own <> '' LEFT JOIN fix p ON p.rid = l.rid AND p.col = l.col AND p.own = '' GROUP BY l.rid""")
def ecc04_apply(spark, d):
    """Records with the state voted most put into each open column: letters changed, dropped and added (ECC-01, ECC-04)."""
    return corrected(reads(spark, d), open_columns(_columns(spark, d)[2]))


@q(f"WITH {_COLS}, held AS (SELECT rid, count(DISTINCT col)::BIGINT AS n_cols FROM (SELECT rid, unnest(range(qs, qe)) AS col FROM vp) GROUP BY rid) SELECT h.rid, n_cols, count(o.col)::BIGINT AS n_open, count(o.col) = 0 AS settled FROM held h LEFT JOIN open_cols o ON o.rid = h.rid AND o.own <> '' GROUP BY h.rid, n_cols")
def ecc07_settled(spark, d):
    """Records whose covered columns are all settled."""
    m, _, cols = _columns(spark, d)
    held = I.union_length(m, "rid", "qs", "qe").select("rid", c("covered").alias("n_cols"))
    o = open_columns(cols).where("own <> ''").groupBy("rid").agg(F.count(F.lit(1)).alias("n_open"))
    return held.join(o, "rid", "left").select("rid", "n_cols", F.coalesce("n_open", F.lit(0)).alias("n_open"), c("n_open").isNull().alias("settled"))


#: Letters of SAM for the operations of a script: paired, paired, only in the target, only in the query.
_SAM = "MMDI"
_OPS = f"""{_CELLS}, ops AS (SELECT id, string_agg((CASE WHEN i = 0 THEN '' WHEN paired THEN 'M' ELSE 'I' END) || repeat('D', added), '' ORDER BY i) AS o FROM (SELECT id, i, paired, added FROM step UNION ALL SELECT id, 0, false, j FROM fr WHERE i = 0) GROUP BY id),
cig AS (SELECT id, array_to_string(list_transform(regexp_extract_all(o, 'M+|I+|D+'), lambda x: length(x) || x[1]), '') AS cigar FROM ops)"""


@q(f"WITH {_OPS} SELECT concat_ws(chr(9), a.name, CASE WHEN s.rev = 1 THEN 16 ELSE 0 END, b.name, s.ts + 1, 255, coalesce(g.cigar, length(qseq) || 'M'), '*', 0, 0, qseq, '*') AS value FROM vp s LEFT JOIN cig g USING (id) JOIN reads a ON a.rid = s.rid JOIN reads b ON b.rid = s.tn")
def snk07_sam(spark, d):
    """The voting matches as SAM lines with their scripts."""

    @F.pandas_udf("string")
    def cigar(a: pd.Series, b: pd.Series, dist: pd.Series) -> pd.Series:
        letters = np.frombuffer(_SAM.encode(), np.uint8)
        out = []
        for ops in scripts.scripts(a.tolist(), b.tolist(), dist.tolist()):
            out.append("".join(f"{n}{chr(op)}" for op, n in scripts.runs(letters[ops])))
        return pd.Series(out, dtype="object")

    n = reads(spark, d).select("rid", "name")
    t = voting(spark, d).withColumn("cigar", cigar("qseq", "tseq", "d"))
    t = t.join(n.select("rid", c("name").alias("qname")), "rid").join(n.select(c("rid").alias("tn"), c("name").alias("tname")), "tn")
    return T.sam(t)


# --- consensus of disputed ranges -------------------------------------------

#: Settled letters kept at either side of a disputed range; ranges whose margins meet are one.
MARGIN = 5


def disputed_ranges(cols, m):
    """rid, s, e: runs of open columns with their margins, cut where a match (rid, qs, qe) starts or ends, so that a match covers a range whole or not at all."""
    cut = m.select("rid", c("qs").alias("col")).unionByName(m.select("rid", c("qe").alias("col"))).distinct().withColumn("cut", c("col"))
    t = cut.unionByName(cols.select("rid", "col").distinct(), allowMissingColumns=True)
    w = Window.partitionBy("rid").orderBy("col", F.desc_nulls_last("cut"))
    t = t.withColumn("lo", F.max("cut").over(w)).withColumn("hi", F.min("cut").over(w.rowsBetween(0, Window.unboundedFollowing))).where("cut is null")
    w = Window.partitionBy("rid", "lo").orderBy("col")
    t = t.withColumn("new", F.coalesce(c("col") - F.lag("col").over(w) > 2 * MARGIN, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(w))
    return t.groupBy("rid", "lo", "hi", "k").agg(F.min("col").alias("a"), F.max("col").alias("b")).select("rid", F.greatest(c("a") - MARGIN, "lo").alias("s"), F.least(c("b") + MARGIN + 1, "hi").alias("e"))


@q()
def ecc02_range_consensus(spark, d):
    """Partial-order consensus of every disputed range of a record over all voting matches that cover it, each with the part of its target that its script puts there (ECC-02)."""
    m, _, cols = _columns(spark, d)
    j = I.point_join(disputed_ranges(open_columns(cols), m.select("rid", "qs", "qe")), m, "rid", "s", "qs", "qe")

    @F.pandas_udf("own string, alt string")
    def part(a: pd.Series, b: pd.Series, dist: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, ops, s, e in zip(a, b, scripts.scripts(a.tolist(), b.tolist(), dist.tolist()), lo, hi):
            at = scripts.boundaries(ops)
            out.append((x[s:e], y[0 if s == 0 else at[s] : at[e]]))
        return pd.DataFrame(out, columns=["own", "alt"])

    # texts of a range repeat: count them before they travel; the graph takes each once with its number as weight
    t = j.select("rid", "s", "e", part("qseq", "tseq", "d", c("s") - c("qs"), c("e") - c("qs")).alias("p"))
    n = t.groupBy("rid", "s", "e", "p.own", "p.alt").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("rid", "s", "e", "own").agg(F.sort_array(F.collect_list(F.struct("alt", "n"))).alias("g"))

    @F.pandas_udf("string")
    def run(own: pd.Series, alts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([consensus.consensus([o, *a], [1, *(int(k) for k in m)]) for o, a, m in zip(own, alts, counts)], dtype="object")

    return g.select("rid", "s", "e", run("own", "g.alt", "g.n").alias("text"), F.size("g").alias("n_texts"))


QUERIES, SQL = q.queries, q.sql

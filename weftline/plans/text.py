"""Text sink queries (SNK) as one value column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks as T
from .common import OVERLAPS, READS, Registry, overlaps, reads
from .kmers import _COUNTS, agg03_histogram
from .relational import _SWEEP, depth
from .scalar import _BIN_CASE

q = Registry()
c = F.col


@q(f"WITH {READS} SELECT '>' || name || chr(10) || seq AS value FROM reads")
def snk01_fasta(spark, d):
    return T.fasta(reads(spark, d))


_Q = f"list_aggregate(list_transform(string_split(qual, ''), lambda ch: CASE ({_BIN_CASE.replace('v ', '(ascii(ch) - 33) ')}) WHEN 0 THEN '*' WHEN 1 THEN '4' WHEN 2 THEN '>' ELSE 'H' END), 'string_agg', '')"


@q(f"WITH {READS} SELECT '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || coalesce({_Q}, repeat('H', len)) AS value FROM reads")
def snk02_fastq(spark, d):
    return T.fastq(reads(spark, d))


@q(f"WITH {OVERLAPS} SELECT concat_ws(chr(9), a.name, o.ql, o.qs, o.qe, CASE WHEN o.rev = 1 THEN '-' ELSE '+' END, b.name, o.tl, o.ts, o.te, o.ml, o.bl, 255) AS value FROM ovl o JOIN reads a ON a.rid = o.qn JOIN reads b ON b.rid = o.tn")
def snk03_paf(spark, d):
    n = reads(spark, d).select("rid", "name")
    o = overlaps(spark, d).join(n.select(c("rid").alias("qn"), c("name").alias("qname")), "qn").join(n.select(c("rid").alias("tn"), c("name").alias("tname")), "tn")
    return T.paf(o)


@q(f"""WITH {OVERLAPS}, l AS (SELECT DISTINCT least(qn, tn) AS u, greatest(qn, tn) AS v, rev, least(qe - qs, te - ts) AS ol FROM ovl WHERE qn <> tn), s AS (SELECT u AS rid FROM l UNION SELECT v FROM l)
SELECT concat_ws(chr(9), 'S', name, seq, 'LN:i:' || len, 'rd:i:1') AS value FROM reads JOIN s USING (rid) UNION ALL SELECT concat_ws(chr(9), 'L', a.name, '+', b.name, CASE WHEN rev = 1 THEN '-' ELSE '+' END, ol || 'M', 'L1:i:' || ol) FROM l JOIN reads a ON a.rid = l.u JOIN reads b ON b.rid = l.v""")
def snk04_gfa(spark, d):
    o = overlaps(spark, d).where("qn <> tn")
    lk = o.select(F.least("qn", "tn").alias("a"), F.greatest("qn", "tn").alias("b"), "rev", F.least(c("qe") - c("qs"), c("te") - c("ts")).alias("ol")).distinct()
    ids = lk.select(c("a").alias("rid")).unionByName(lk.select(c("b").alias("rid"))).distinct()
    r = reads(spark, d)
    seg = r.join(ids, "rid", "left_semi").select("name", "seq", F.lit(1).alias("depth"))
    n = r.select("rid", "name")
    lk = lk.join(n.select(c("rid").alias("a"), c("name").alias("u")), "a").join(n.select(c("rid").alias("b"), c("name").alias("v")), "b")
    return T.gfa(seg, lk.select("u", F.lit(0).alias("u_rev"), "v", c("rev").alias("v_rev"), "ol")).select("value")


@q(f"WITH {OVERLAPS}, {_SWEEP} SELECT concat_ws(chr(9), name, s, e, depth) AS value FROM depth JOIN reads USING (rid) WHERE depth <= 1")
def snk05_bed(spark, d):
    t = depth(spark, d).where("depth <= 1").join(reads(spark, d).select("rid", "name"), "rid")
    return T.bed(t.select("name", "s", "e", c("depth").alias("score")))


@q(f"WITH {_COUNTS}, h AS (SELECT cnt, count(*) AS n FROM counts GROUP BY cnt) SELECT cnt::INTEGER AS cnt, concat_ws(chr(9), cnt, repeat('*', floor(100.0 * n / (SELECT max(n) FROM h) + 0.499)::INTEGER), n) AS value FROM h")
def snk09_histogram(spark, d):
    return T.histogram_lines(agg03_histogram(spark, d))


QUERIES, SQL = q.queries, q.sql

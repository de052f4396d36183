"""Queries through files: records written and scanned again, stored stages, count tables, packed letters, neighbourhoods (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kmers as K
from ..scratch import Scratch
from ..sources import checkpoints, fastx
from ..sources import sinks as T
from .common import EDGES, OVERLAPS, READS, RUNS, Registry, edges, overlaps, reads, runs
from .kmers import _COUNTS, KLEN, counts, named

q = Registry()
c = F.col


@q(f"WITH {READS} SELECT name, seq, len FROM reads")
def src01_fastx_scan(spark, d):
    """All records as FASTA files in the shared folder, scanned back in byte ranges."""
    at = Scratch(spark, "fasta").root
    T.write_text(T.fasta(reads(spark, d)), at)
    files = at.removeprefix("file://").removeprefix("file:")
    return fastx.read_fastx(spark, f"{files}/part-*", split_bytes=1 << 20).select("name", "seq", "len")


@q(f"WITH {READS} SELECT rid, name, seq, len FROM reads")
def src03_stored_reads(spark, d):
    """The record stage, written with its options and loaded under the same ones (SRC-03, SNK-06)."""
    at = Scratch(spark, "reads").root
    checkpoints.save(reads(spark, d), at, adapter_len=0)
    return checkpoints.load(spark, at, adapter_len=0).select("rid", "name", "seq", "len")


@q(f"WITH {OVERLAPS} SELECT qn, qs, qe, tn, ts, te, rev, ml, bl FROM ovl")
def src04_stored_overlaps(spark, d):
    at = Scratch(spark, "overlaps").root
    checkpoints.save(overlaps(spark, d), at, max_diff=0.04)
    return checkpoints.load(spark, at, max_diff=0.04).select("qn", "qs", "qe", "tn", "ts", "te", "rev", "ml", "bl")


@q(f"WITH {_COUNTS}, {RUNS}, keys AS (SELECT DISTINCT kmer FROM kmers JOIN runs USING (rid) WHERE place = 2) SELECT kmer, (CASE WHEN cnt >= 4095 THEN -1 ELSE coalesce(cnt, 0) END)::BIGINT AS cnt FROM keys LEFT JOIN counts USING (kmer)")
def src09_table_lookup(spark, d):
    """Keys of one run looked up in the stored count table of all records; saturated counts read -1."""
    at = Scratch(spark, "counts").root
    checkpoints.save(counts(spark, d), at, k=KLEN)
    keys = K.kmer_counts(reads(spark, d).join(runs(spark, d).where("place = 2"), "rid", "left_semi"), KLEN).select("code")
    return named(checkpoints.lookup(keys, checkpoints.load(spark, at, k=KLEN), K.COUNT_MAX)).select("kmer", c("cnt").cast("long").alias("cnt"))


@q(f"""WITH {EDGES}, e AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), near AS (SELECT rid AS start, rid FROM reads WHERE rid % 50 = 0 UNION SELECT e.u, e.v FROM e WHERE e.u % 50 = 0)
SELECT n.start, concat_ws(chr(9), a.name, o.ql, o.qs, o.qe, CASE WHEN o.rev = 1 THEN '-' ELSE '+' END, b.name, o.tl, o.ts, o.te, o.ml, o.bl, 255) AS value FROM near n JOIN near m ON m.start = n.start JOIN ovl o ON o.qn = n.rid AND o.tn = m.rid JOIN reads a ON a.rid = o.qn JOIN reads b ON b.rid = o.tn""")
def snk11_neighbourhood_paf(spark, d):
    """Matches among a record of the query set (ids divisible by 50) and its partners, as PAF lines."""
    e = edges(spark, d)
    b = e.select("u", "v").unionByName(e.select(c("v").alias("u"), c("u").alias("v")))
    r = reads(spark, d)
    near = G.levels(b, r.where("rid % 50 = 0").select(c("rid").alias("start"), c("rid").alias("node")), 1)
    n = r.select("rid", "name")
    # a match meets each query record that has both of its ends near
    o = overlaps(spark, d).join(near.select("start", c("node").alias("qn")), "qn").join(near.select("start", c("node").alias("tn")), ["start", "tn"])
    o = o.join(n.select(c("rid").alias("qn"), c("name").alias("qname")), "qn").join(n.select(c("rid").alias("tn"), c("name").alias("tname")), "tn")
    return o.select("start", *[x for x in o.columns if x != "start"]).select("start", F.concat_ws("\t", "qname", "ql", "qs", "qe", T.strand(c("rev")), "tname", "tl", "ts", "te", "ml", "bl", F.lit(255)).alias("value"))


#: Letters of a packed block: 62 bits.
BLOCK = 31


@q(f"""WITH {READS}, b AS (SELECT rid, k::INTEGER AS block, substr(seq, (k * {BLOCK} + 1)::INTEGER, {BLOCK}) AS t FROM (SELECT rid, seq, unnest(range(0, (len + {BLOCK - 1}) // {BLOCK})) AS k FROM reads))
SELECT rid, block, length(t)::INTEGER AS n, (length(t) - length(regexp_replace(t, '[^ACGT]', '', 'g')))::INTEGER AS n_other, list_sum(list_transform(range(1, length(t) + 1), lambda i: greatest(instr('ACGT', t[i]) - 1, 0)::BIGINT * (1::BIGINT << (2 * (length(t) - i))::INTEGER)))::BIGINT AS code FROM b""")
def snk12_packed_blocks(spark, d):
    """Letters in blocks of two bits each; others are packed as A and counted."""
    t = reads(spark, d).select("rid", "seq", F.posexplode(F.expr(f"sequence(1, len, {BLOCK})")).alias("block", "at"))
    t = t.select("rid", "block", F.expr(f"substr(seq, at, {BLOCK})").alias("t"))
    code = F.expr("aggregate(sequence(1, length(t)), 0L, (a, i) -> a * 4 + greatest(instr('ACGT', substr(t, i, 1)) - 1, 0))")
    return t.select("rid", "block", F.length("t").alias("n"), (F.length("t") - F.length(F.regexp_replace("t", "[^ACGT]", ""))).alias("n_other"), code.alias("code"))


QUERIES, SQL = q.queries, q.sql

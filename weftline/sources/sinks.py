"""Text sinks: every format is a projection to one text column, written with ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import quality_bins, quality_from_bins

c = F.col


def fasta(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def fastq(reads: DataFrame) -> DataFrame:
    """Qualities leave as the value of their bin (9, 19, 29 or 39); records without quality get the highest."""
    q = F.coalesce(quality_from_bins(quality_bins(c("qual"))), F.repeat(F.lit("H"), F.length("seq")))
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), q).alias("value"))


def strand(rev: Column) -> Column:
    return F.when(rev == 1, "-").otherwise("+")


def paf(o: DataFrame) -> DataFrame:
    """Twelve columns: name, length, start, end of both sides, strand, matches, block, 255."""
    return o.select(F.concat_ws("\t", "qname", "ql", "qs", "qe", strand(c("rev")), "tname", "tl", "ts", "te", "ml", "bl", F.lit(255)).alias("value"))


def gfa(segments: DataFrame, links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """S, L and A lines with a sort key (contig, line type). segments: name, seq, depth; links: u, u_rev, v, v_rev, ol; members: name, pos, rev, read, s, e, rid, hap."""
    s = segments.select(c("name").alias("k"), F.lit(0).alias("t"), F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.length("seq")), F.concat(F.lit("rd:i:"), "depth")).alias("value"))
    lk = links.select(c("u").alias("k"), F.lit(2).alias("t"), F.concat_ws("\t", F.lit("L"), "u", strand(c("u_rev")), "v", strand(c("v_rev")), F.concat(c("ol"), F.lit("M")), F.concat(F.lit("L1:i:"), "ol")).alias("value"))
    out = s.unionByName(lk)
    if members is not None:
        a = members.select(c("name").alias("k"), F.lit(1).alias("t"), F.concat_ws("\t", F.lit("A"), "name", "pos", strand(c("rev")), "read", "s", "e", F.concat(F.lit("id:i:"), "rid"), F.concat(F.lit("HG:A:"), "hap")).alias("value"))
        out = out.unionByName(a)
    return out


def bed(regions: DataFrame) -> DataFrame:
    return regions.select(F.concat_ws("\t", "name", "s", "e", "score").alias("value"))


def sam(o: DataFrame) -> DataFrame:
    """One line an alignment: name, flag, target, 1-based place, 255, script, sequence."""
    flag = F.when(c("rev") == 1, 16).otherwise(0)
    return o.select(F.concat_ws("\t", "qname", flag, "tname", c("ts") + 1, F.lit(255), "cigar", F.lit("*"), F.lit(0), F.lit(0), "qseq", F.lit("*")).alias("value"))


def histogram_lines(hist: DataFrame) -> DataFrame:
    """A line of stars a count, scaled so that the highest has 100."""
    top = hist.agg(F.max("n").alias("_m"))
    stars = F.expr("repeat('*', cast(floor(100.0 * n / _m + 0.499) as int))")
    return hist.join(F.broadcast(top)).select("cnt", F.concat_ws("\t", "cnt", stars, "n").alias("value"))


def write_text(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write lines, in order if ``order`` names columns (range partitioned, so files follow each other)."""
    (lines.orderBy(*order) if order else lines).select("value").write.mode("overwrite").text(path)

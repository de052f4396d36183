"""Queries on small tables where a prefix, a cap or a fixed number of rounds would show."""

import random

from weftline.kernels import consensus
from weftline.operators import graph as G
from weftline.plans import advanced
from weftline.plans import consensus as votes

PAF = "x_id long, x_pos_s long, x_pos_e long, x_pos_strand int, y_id long, y_pos_s long, y_pos_e long, y_pos_strand int, match_len long, total_len long"


def folder(spark, path, seqs, matches):
    spark.createDataFrame([(i, f"r{i}", s, "") for i, s in enumerate(seqs)], "rid long, read_name string, seq string, qual string").write.parquet(f"{path}/kseq_reads.parquet")
    spark.createDataFrame([(q, s, e, 0, t, ts, ts + e - s, 0, e - s, e - s) for q, s, e, t, ts in matches], PAF).write.parquet(f"{path}/paf.parquet")
    return str(path)


def text(n, seed=1):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def put(s, i, x):
    return s[:i] + x + s[i + 1 :]


def test_range_consensus_inside_a_record(spark, tmp_path):
    good = text(120)
    bad = put(good, 80, "A" if good[80] != "A" else "C")
    d = folder(spark, tmp_path, [bad] + [good] * 3, [(0, 10, 120, t, 10) for t in (1, 2, 3)])
    assert [tuple(r) for r in votes.ecc02_range_consensus(spark, d).where("rid = 0").collect()] == [(0, 75, 86, good[75:86], 1)]
    # a match that ends inside the run of disputed columns: both parts are seen with all their matches
    worse = put(bad, 84, "A" if good[84] != "A" else "C")
    d = folder(spark, tmp_path / "b", [worse] + [good] * 4, [(0, 10, 120, t, 10) for t in (1, 2, 3)] + [(0, 10, 83, 4, 10)])
    got = {tuple(r) for r in votes.ecc02_range_consensus(spark, d).where("rid = 0").collect()}
    assert got == {(0, 75, 83, good[75:83], 1), (0, 83, 90, good[83:90], 1)}


def test_consensus_weighs_by_true_counts():
    assert consensus.consensus(["ACGT", "ACCT", "ACGT"], [1, 100, 90]) == "ACCT"
    assert consensus.consensus(["ACGT", "ACCT", "ACGT"], [1, 100, 101]) == "ACGT"


def test_whole_span_is_placed(spark, tmp_path):
    a = text(200)
    b = put(a, 150, "A" if a[150] != "A" else "C")
    d = folder(spark, tmp_path, [a, b], [(0, 0, 200, 1, 0)])
    assert [tuple(r)[5:] for r in advanced.aln03_semi_global(spark, d).collect()] == [(1, 0, 200)]


def test_tips_until_none(spark):
    """A full binary tree of 12 levels towards its root: each round bares the next level."""
    arcs = [(2 * h, 2 * (h // 2), 1, 9) for h in range(2, 1 << 13)]
    assert G.clean_tips(spark.createDataFrame(arcs, "u long, v long, len int, ol int"), 1).isEmpty()

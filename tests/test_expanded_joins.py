"""Tables of k-mers look small to Catalyst: no join may send them to the driver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import kmers as K
from weftline.plans import advanced, catalog
from weftline.plans.common import reads

PAF = "x_id long, x_pos_s long, x_pos_e long, x_pos_strand int, y_id long, y_pos_s long, y_pos_e long, y_pos_strand int, match_len long, total_len long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two parents of 8 records each that share the half of their letters, and 8 records of other runs that mix them."""
    d = str(tmp_path_factory.mktemp("trio"))
    rnd = random.Random(5)
    a, b, both = ("".join(rnd.choice("ACGT") for _ in range(150)) for _ in range(3))
    seqs = [(a + both, "r0")] * 8 + [(b + both, "r1")] * 7 + [(a[:80] + b[:80], "r2"), (a[20:110], "r3"), (b, "r4"), (both, "r5")]
    spark.createDataFrame([(i, f"n{i}", s, "", r) for i, (s, r) in enumerate(seqs)], "rid long, read_name string, seq string, qual string, run_id string").write.parquet(f"{d}/kseq_reads.parquet")
    spark.createDataFrame([(q, 0, 80, 0, t, 0, 80, 0, 80, 80) for q in range(15, 19) for t in range(15, 19)], PAF).write.parquet(f"{d}/paf.parquet")
    return d


def sent(plan: str) -> list[str]:
    """Lines of a plan that broadcast k-mers: an exchange of that kind with a kernel under it."""
    lines, out = plan.split("\n"), []
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    for i, x in enumerate(lines):
        below = range(i + 1, next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)))
        if "BroadcastExchange" in x and any("MapInArrow" in lines[j] for j in below):
            out.append(x)
    return out


@pytest.mark.parametrize("name", ["agg16_trio_counts", "sca13_trio_class", "pha07_by_class", "scf06_switches", "pha08_unique_hits"])
def test_no_broadcast_of_kmers(spark, folder, name):
    assert sent(catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()) == []


def test_trio_counts(spark, folder):
    got = {r["rid"]: tuple(r)[1:] for r in catalog.QUERIES["agg16_trio_counts"](spark, folder).select("rid", "n_p", "n_m", "run_p", "run_m").collect()}
    assert len(got) == 19
    seqs = [r["seq"] for r in spark.read.parquet(f"{folder}/kseq_reads.parquet").orderBy("rid").collect()]
    a, b = ({s[i : i + 21] for i in range(len(s) - 20)} for s in (seqs[0], seqs[8]))
    for rid in range(15, 19):
        own = [[x in k and x not in o for x in (seqs[rid][i : i + 21] for i in range(len(seqs[rid]) - 20))] for k, o in ((a, b), (b, a))]
        assert got[rid] == tuple(map(sum, own)) * 2  # every run here is long enough
    assert got[16] == (70, 0, 70, 0) and got[18] == (0, 0, 0, 0)


def test_filter_misses_no_code(spark, folder):
    r = spark.read.parquet(f"{folder}/kseq_reads.parquet")
    every = {tuple(x) for x in K.kmer_positions(r, 21).collect()}
    codes = {x[2] for x in every if x[0] == 16}
    t = spark.createDataFrame([(x,) for x in codes], "code long")
    for most in (19, K.FILTER_BITS):
        only = K.code_filter(t, most)
        assert only.dtype == np.uint8 and len(only) == 1 << 16
        kept = {tuple(x) for x in K.kmer_positions(r, 21, only=only).collect()}
        assert {x for x in every if x[2] in codes} <= kept < every
    assert not K.kmer_positions(r, 21, only=K.code_filter(t.limit(0))).count()


def test_filter_stays_sharp(spark):
    """Of the places of other codes one in a hundred is shuffled at most."""
    only = K.code_filter(spark.range(40_000).withColumnRenamed("id", "code"))
    assert np.unpackbits(only).mean() < 0.01


def test_other_runs_are_not_shuffled(spark, folder):
    """Letters of records outside the parents' runs are ruled out where they are read, and no other letters change."""
    own = spark.createDataFrame([(x,) for x in range(3)], "code long")
    got = {r["rid"]: r["seq"] for r in reads(spark, folder, only=K.code_filter(own)).collect()}
    every = {r["rid"]: r["seq"] for r in reads(spark, folder).collect()}
    assert {0, 1, 2} <= got.keys() and len(got) < len(every) == 19 and got.items() <= every.items()
    plan = advanced.parent_flags(spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    letters = [i for i, x in enumerate(plan) if "Aggregate" in x and "max(seq" in x]
    assert len(letters) == 2 and all(any("MapInArrow" in x for x in plan[i + 1 : i + 5]) for i in letters)


def test_parents_are_not_broadcast(spark, folder):
    """The driver holds a bitmap of the parents' records, not a table of them."""
    assert "BroadcastExchange" not in advanced.parent_flags(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_parents_of_records_in_two_runs(spark, folder, tmp_path):
    """A record that was delivered for both parents counts for the run named first; deliveries without a run or a record change nothing."""
    t = spark.read.parquet(f"{folder}/kseq_reads.parquet")
    more = t.where("rid < 8").withColumns({"run_id": F.lit("r1"), "seq": F.lower("seq")}).unionByName(t.where("rid >= 8 and rid < 15").withColumn("run_id", F.lit(None).cast("string")))
    t.unionByName(more).unionByName(t.where("rid = 18").withColumns({"rid": F.lit(None).cast("long"), "run_id": F.lit("r0")})).write.parquet(f"{tmp_path}/kseq_reads.parquet")
    a, b = ({tuple(r) for r in advanced.parent_flags(spark, d).collect()} for d in (folder, str(tmp_path)))
    assert a == b and len(a) > 300

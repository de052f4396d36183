import random
import re

from test_whole_jobs import PAF, text

from weftline.kernels import align, scripts
from weftline.plans import consensus


def mutate(rnd, s, rate):
    out = []
    for ch in s:
        x = rnd.random()
        if x < rate / 3:
            continue
        out.append(rnd.choice("ACGT") if x < 2 * rate / 3 else ch)
        if x > 1 - rate / 3:
            out.append(rnd.choice("ACGT"))
    return "".join(out)


def test_scripts_are_shortest_and_rebuild_the_target():
    rnd = random.Random(3)
    a = ["", "A", "", "AC", "ACGT"] + [text(rnd.randint(0, 300), i) for i in range(400)]
    b = ["A", "", "", "CA", "ACGT"] + [mutate(rnd, x, rnd.choice([0, 0.02, 0.1, 0.6, 1.5])) for x in a[5:]]
    d = [align.distance(x, y) for x, y in zip(a, b)]
    for x, y, k, ops in zip(a, b, d, scripts.scripts(a, b, d)):
        r = scripts.runs(ops)
        assert align.errors(r) == k and align.apply_script(x, y, r) == y
        at = scripts.boundaries(ops)
        assert len(at) == len(x) + 1 and at[-1] == len(y) and (at[1:] >= at[:-1]).all()
        # the differences inside, put into the query, give the target but for text beyond its ends
        letters, before = list(x), {}
        for i, own, base in scripts.differences(x, y, ops):
            assert own == (x[i] if base[0] != "+" else "")
            if base[0] == "+":
                before[i] = base[1:]
            else:
                letters[i] = "" if base == "-" else base
        head = r[0][1] if r and r[0][0] == align.MORE_TARGET else 0
        tail = r[-1][1] if len(r) > 1 and r[-1][0] == align.MORE_TARGET else 0
        assert not x or "".join(before.get(i, "") + ch for i, ch in enumerate(letters)) == y[head : len(y) - tail]


def test_planted_errors_of_every_kind_are_corrected(spark, tmp_path):
    good = text(300, 9)
    flip = "A" if good[80] != "A" else "C"
    bad = good[:80] + flip + good[81:150] + good[151:210] + "GATC" + good[210:]
    seqs = [bad, good, good, good, good, "N" * 5]
    spark.createDataFrame([(i, f"r{i}", s, None) for i, s in enumerate(seqs)], "rid long, read_name string, seq string, qual string").write.parquet(f"{tmp_path}/kseq_reads.parquet")
    rows = [(0, 0, len(bad), 0, t, 0, 300, 0, 290, 300) for t in (1, 2, 3, 4)] + [(0, 0, len(bad), 0, 1, 0, 300, 0, 290, 300), (None, 0, 5, 0, 1, 0, 5, 0, 5, 5), (1, 0, 5, None, 5, 0, 5, 0, 0, 5)]
    spark.createDataFrame(rows, PAF).write.parquet(f"{tmp_path}/paf.parquet")
    d = str(tmp_path)
    assert [(r["rid"], r["seq"]) for r in consensus.ecc04_apply(spark, d).collect()] == [(0, good)]
    opened = {(r["own"] == "", r["n"], r["m"]) for r in consensus.agg13_open_columns(spark, d).collect()}
    assert opened == {(False, 5, 1), (True, 5, 1)}
    assert {r["alt"] for r in consensus.sites(consensus._columns(spark, d)[2]).collect()} == {good[80], "-"}
    assert [tuple(r) for r in consensus.ecc07_settled(spark, d).where("rid = 0").collect()] == [(0, len(bad), 5, False)]
    assert {r["text"] for r in consensus.ecc02_range_consensus(spark, d).collect()} >= {good[75:86]}
    cigars = {r["value"].split("\t")[5] for r in consensus.snk07_sam(spark, d).collect()}
    assert len(cigars) == 1
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MID])", cigars.pop())]
    assert {x: sum(n for n, op in ops if op == x) for x in "MID"} == {"M": 299, "I": 4, "D": 1}


def test_no_matches(spark, tmp_path):
    spark.createDataFrame([(0, "r", None, None), (1, "s", "", None), (2, "t", "ACGT" * 30, None)], "rid long, read_name string, seq string, qual string").write.parquet(f"{tmp_path}/kseq_reads.parquet")
    spark.createDataFrame([], PAF).write.parquet(f"{tmp_path}/paf.parquet")
    for f in (consensus.agg13_open_columns, consensus.agg14_pileup, consensus.ecc04_apply, consensus.ecc02_range_consensus, consensus.snk07_sam):
        assert f(spark, str(tmp_path)).count() == 0

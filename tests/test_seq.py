import random

from pyspark.sql import functions as F

from weftline.functions import seq as S
from weftline.operators import intervals as I
from weftline.operators import kmers as K


def test_arc_rule(spark):
    cases = [
        (1000, 400, 1000, 1000, 0, 600, 0, "ARC", 2, 4, 400, 600), (1000, 400, 1000, 1000, 400, 1000, 1, "ARC", 2, 5, 400, 600), (1000, 0, 600, 1000, 400, 1000, 0, "ARC", 3, 5, 400, 600),
        (1000, 0, 600, 1000, 0, 600, 1, "ARC", 3, 4, 400, 600), (500, 0, 500, 1000, 200, 700, 0, "QCONT", None, None, None, None), (1000, 200, 700, 500, 0, 500, 0, "TCONT", None, None, None, None),
        (1000, 970, 1000, 1000, 0, 30, 0, "SHORT", None, None, None, None), (5000, 2000, 3000, 5000, 2000, 3000, 0, "INT", None, None, None, None), (1000, 400, 980, 1000, 10, 600, 0, "ARC", 2, 4, 390, 610),
    ]
    df = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(cases)], "i int, ql long, qs long, qe long, tl long, ts long, te long, rev int")
    a = S.arc_fields(F.lit(1), F.lit(2), *[F.col(x) for x in ("qs", "qe", "ql", "ts", "te", "tl", "rev")])
    got = df.select("i", a.alias("a")).orderBy("i").collect()
    assert [tuple(r["a"]) for r in got] == [c[7:] for c in cases]


def test_trio_rule(spark):
    cases = [(0, 0, 0, 0, "0"), (0, 0, 40, 0, "p"), (0, 0, 0, 40, "m"), (0, 0, 20, 0, "0"), (100, 0, 100, 5, "p"), (0, 100, 5, 100, "m"), (40, 40, 50, 50, "a"), (100, 10, 100, 5, "a")]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, a long, b long, c long, d long")
    got = df.select("i", S.trio_class(*[F.col(x) for x in "abcd"]).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [c[4] for c in cases]


def test_text_functions(spark):
    df = spark.createDataFrame([("AAACCGTTTT", "!+5?~"), ("acgtN", None), ("", ""), (None, None)], "s string, q string")
    r = df.select(S.collapse_homopolymers(F.col("s")), S.reverse_complement(S.reverse_complement(F.col("s"))), S.encode_bases(F.col("s")), S.quality_bins(F.col("q")), S.quality_sum(F.col("q")), S.quality_from_bins(S.quality_bins(F.col("q")))).collect()
    assert tuple(r[0]) == ("ACGT", "AAACCGTTTT", "0001123333", "00123", 0 + 10 + 20 + 30 + 93, "**4>H")
    assert r[1][1] == "acgtN" and r[1][2] == "01234" and tuple(r[3]) == (None,) * 6


def test_hash_is_a_bijection_and_matches_arrays(spark):
    import numpy as np

    df = spark.range(4096).select("id", S.hash64(F.col("id"), 12).alias("h"), S.hash64(F.col("id") * 1000003, 42).alias("g"))
    rows = df.collect()
    assert sorted(r["h"] for r in rows) == list(range(4096))
    ids = np.array([r["id"] for r in rows], np.uint64) * np.uint64(1000003)
    assert K._mixed(ids, 42).astype(np.int64).tolist() == [r["g"] for r in rows]


def test_kmers_by_brute_force(spark):
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("ACGTN" if rnd.random() < 0.1 else "ACGTacgt") for _ in range(rnd.randint(0, 60))) for _ in range(40)] + [None, "", "ACG", "A" * 50]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want: dict[str, int] = {}
    for s in seqs:
        u = (s or "").upper()
        for i in range(len(u) - 6):
            w = u[i : i + 7]
            if not set(w) - set("ACGT"):
                want[min(w, rc(w))] = want.get(min(w, rc(w)), 0) + 1
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(seqs)], "rid long, seq string, code string, n int")
    got = {r["k"]: r["cnt"] for r in K.kmer_counts(df, 7).select(K.decode(F.col("code"), 7).alias("k"), "cnt").collect()}
    assert got == want
    assert K.kmer_positions(df, 7).count() == sum(want.values())
    # every full window of 4 k-mers of a run holds a minimizer
    mz = {(r["rid"], r["pos"]) for r in K.minimizers(df, 7, 4).collect()}
    own = lambda w: w == rc(w)
    for i, s in enumerate(seqs):
        u = (s or "").upper()
        for p in range(len(u) - 9):
            win = u[p : p + 10]
            if not set(win) - set("ACGT") and not any(own(win[j : j + 7]) for j in range(4)):
                assert any((i, p + j) in mz for j in range(4))
    assert K.kmer_counts(df.where("false"), 7).count() == 0


def test_sweep_and_joins(spark):
    iv = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 15, 20), (1, 2, 4), (2, 3, 3)], "id long, s long, e long")
    got = [tuple(r) for r in I.depth_sweep(iv, "id", "s", "e").orderBy("s").collect()]
    assert got == [(1, 0, 2, 1), (1, 2, 4, 2), (1, 4, 5, 1), (1, 5, 10, 2), (1, 10, 15, 1), (1, 15, 20, 1)]
    rnd = random.Random(8)
    mk = lambda: [(k % 3, a, a + rnd.randint(0, 900)) for k in range(60) for a in [rnd.randint(0, 2000)]]
    a, b = mk(), mk()
    x, y = spark.createDataFrame(a, "k long, s long, e long"), spark.createDataFrame(b, "k long, s2 long, e2 long")
    got = sorted(tuple(r) for r in I.overlap_join(x, y, "k", "s", "e", "s2", "e2").select("k", "s", "e", "s2", "e2").collect())
    assert got == sorted((k, s, e, s2, e2) for k, s, e in a for k2, s2, e2 in b if k == k2 and max(s, s2) < min(e, e2))
    u = {r["k"]: r["covered"] for r in I.union_length(x, "k", "s", "e").collect()}
    assert u == {k: len({p for k2, s, e in a if k2 == k for p in range(s, e)}) for k in range(3)}

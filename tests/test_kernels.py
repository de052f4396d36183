import itertools
import random

import numpy as np

from weftline.kernels import align, bits, chain, consensus, maxcut, peaks
from weftline.kernels.random import Stream, splitmix64


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def words(rnd, n, k=14):
    return ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, k))) for _ in range(n)]


def test_scripts_against_dynamic_programming():
    rnd = random.Random(1)
    for a, b in zip(words(rnd, 200), words(rnd, 200)):
        s = align.script(a, b)
        assert align.distance(a, b) == lev(a, b) == align.errors(s)
        assert align.apply_script(a, b, align.decode_script(align.encode_script(s))) == b
    assert align.distance("ACT", "AAT") == 1 and align.distance("ACTTTTTT", "AATTTT") == 3
    assert align.distance("GATTACA", "GACTATA") == 2 and align.distance("TGT", "CTGT") == 1
    assert align.distance("AAAA", "TTTT", 3) == -1


def test_free_ends_and_extension():
    rnd = random.Random(2)
    for a, b in zip(words(rnd, 150, 9), words(rnd, 150)):
        if a and b:
            d, s, e = align.find(a, b)
            assert d == min(lev(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == lev(a, b[s:e])
            i, j, n = align.extend(a, b, 2)
            assert n <= 2 and lev(a[:i], b[:j]) == n
            assert i + j == max(x + y for x in range(len(a) + 1) for y in range(len(b) + 1) if lev(a[:x], b[:y]) <= 2 and (x and y)) if i else True


def test_long_runs_and_exact_part():
    assert align.encode_script([(0, 40000)]) == [16383, 16383, 7234]
    assert align.decode_script(align.encode_script([(0, 40000), (2, 1)])) == [(0, 40000), (2, 1)]
    assert align.longest_exact([(0, 3), (1, 1), (3, 2), (0, 9), (2, 4), (0, 9)]) == (6, 9)


def test_affine_against_full_table():
    def full(a, b, m=2, x=4, o=4, e=2):
        low, best = -(10**9), 0
        h = {(0, 0): 0}
        ins, dele = {}, {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ins[i, j] = max(ins.get((i, j - 1), low), h.get((i, j - 1), low) - o) - e
                dele[i, j] = max(dele.get((i - 1, j), low), h.get((i - 1, j), low) - o) - e
                d = h.get((i - 1, j - 1), low) + (m if i and j and a[i - 1] == b[j - 1] else -x)
                h[i, j] = 0 if not i and not j else max(d, ins[i, j], dele[i, j])
                best = max(best, h[i, j])
        return best

    rnd = random.Random(3)
    for a, b in zip(words(rnd, 80, 12), words(rnd, 80, 12)):
        assert align.affine(a, b)[0] == (full(a, b) if a and b else 0)


def test_increasing_and_chain():
    assert chain.increasing([3, 1, 4, 1, 5, 9, 2, 6]) == 4 and chain.increasing([5, 5, 5]) == 1
    rnd = random.Random(4)
    rule = chain.ChainRule(span=5, band=0.5, gap=0.2, skip=0.0)
    for _ in range(60):
        n = rnd.randint(1, 7)
        q, t = np.array([rnd.randint(0, 30) for _ in range(n)]), np.array([rnd.randint(0, 30) for _ in range(n)])
        w = np.ones(n, int)
        s, path = chain.chain(q, t, w, rule)
        assert all(q[a] < q[b] and t[a] < t[b] for a, b in zip(path, path[1:]))
        # the best over all increasing orders, scored link by link
        best = 0.0
        for k in range(1, n + 1):
            for sub in itertools.permutations(range(n), k):
                v, first = 5.0, sub[0]
                for a, b in zip(sub, sub[1:]):
                    v += chain.pair_score(np.array([q[b] - q[a]]), np.array([t[b] - t[a]]), 1, np.array([max(t[b] - t[first], 1)]), rule)[0]
                best = max(best, v)
        assert s == best
    got = chain.chains(np.array([0, 10, 20, 0, 10]), np.array([0, 10, 20, 900, 910]), np.ones(5, int), 0.5)
    assert [len(p) for _, p in got] == [3, 2]


def test_max_cut_against_all_assignments():
    rnd = random.Random(6)
    for _ in range(15):
        n = rnd.randint(2, 8)
        e = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.6] or [(0, 1)]
        u, v = np.array([a for a, _ in e]), np.array([b for _, b in e])
        w = np.array([rnd.choice([-3, -1, 1, 2, 5]) for _ in e], float)
        best = max(maxcut.score(np.array(s), u, v, w) for s in itertools.product((-1, 1), repeat=n))
        assert maxcut.score(maxcut.solve(n, u, v, w), u, v, w) == best


def test_peaks():
    fall = {i: 1000 - 10 * i for i in range(1, 60)}
    assert peaks.find_peaks(fall).hom == -1
    bump = lambda at, top: {at + d: int(top * (1 - abs(d) / 6)) for d in range(-5, 6)}
    h = {5: 40, 6: 30, 7: 20, 8: 10} | bump(15, 1000) | bump(30, 400)
    assert (peaks.find_peaks(h).hom, peaks.find_peaks(h).het) == (30, 15)
    h = {5: 40, 6: 30, 7: 20, 8: 10} | bump(15, 400) | bump(30, 1000)
    assert (peaks.find_peaks(h).hom, peaks.find_peaks(h).het) == (30, 15)


def test_generator():
    assert [int(splitmix64(np.array([1234567], np.uint64))[0][0])] == [6457827717110365317]
    assert Stream(11).uniform() == Stream(11).uniform()
    assert sorted(Stream(3).shuffle(20)) == list(range(20))


def test_consensus():
    assert consensus.consensus(["ACGTACGT", "ACGTTACGT", "ACGTTACGT"]) == "ACGTTACGT"
    assert consensus.consensus(["ACGT", "ACCT", "ACCT"]) == "ACCT"
    assert consensus.consensus([]) == "" and consensus.consensus(["", "AC"]) == "AC"


def test_packing_of_letters():
    text = "ACGTTGCANACG"
    code = bits.CODE[np.frombuffer(text.encode(), np.uint8)]
    f, r = bits.packed(code, 3), bits.packed_reverse(code, 3)
    val = lambda s: sum("ACGT".index(c) << (2 * (len(s) - 1 - i)) for i, c in enumerate(s))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for i in range(len(text) - 2):
        w = text[i : i + 3]
        if "N" not in w:
            assert f[i] == val(w) and r[i] == val(rc(w))
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (bits.unmix(bits.mix(x)) == x).all()
    h = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert bits.sliding_min(h, 3).tolist() == [3, 1, 1, 1] and bits.sliding_min(h, 1).tolist() == h.tolist()


def test_long_kmers_equal_brute_force(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from weftline.operators import kmers as K

    rnd = random.Random(8)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 150))) for _ in range(30)] + ["ACGT" * 40, "A" * 90, None, "", "ACN" * 50, "at" * 60]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(99, seqs[0])], "rid long, seq string")
    flip = str.maketrans("ACGT", "TGCA")
    for k in (33, 51, 63):
        want = Counter()
        for s in [*seqs, seqs[0]]:
            u = (s or "").upper()
            for i in range(len(u) - k + 1):
                w = u[i : i + k]
                if not set(w) - set("ACGT"):
                    want[min(w, w[::-1].translate(flip))] += 1
        t = K.long_kmer_counts(df, k).select(K.decode_long(F.col("hi"), F.col("lo"), k).alias("kmer"), "cnt")
        assert {r["kmer"]: r["cnt"] for r in t.collect()} == want

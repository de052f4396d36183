import random

import pytest

from weftline.llm import rlz_spans

SCHEMA = "rid long, seq string, mz long, block int, s int, k1 string"


def brute(rows, n):
    where = {}
    for rid, seq in rows:
        if rid is None or not seq:
            continue
        u = seq.upper()
        for i in range(len(u) - n + 1):
            w = u[i : i + n]
            if not set(w) - set("ACGT"):
                where.setdefault(w, set()).add((rid, i))
    hit = {}
    for places in where.values():
        if len({r for r, _ in places}) > 1:
            for r, i in places:
                hit.setdefault(r, set()).update(range(i, i + n))
    out = set()
    for r, p in hit.items():
        s = sorted(p)
        a = s[0]
        for x, y in zip(s, s[1:] + [None]):
            if y != x + 1:
                out.add((r, a, x + 1))
                a = y
    return out


def records(seed=1, n=60):
    rnd = random.Random(seed)
    dna = lambda k: "".join(rnd.choice("ACGT") for _ in range(k))
    shared = [dna(rnd.randint(30, 360)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [dna(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) - 1)
            parts += [s[a : a + rnd.randint(20, 330)], dna(rnd.randint(0, 30))]
        t = "".join(parts)
        if rnd.random() < 0.2 and t:
            p = rnd.randint(0, len(t) - 1)
            t = t[:p] + "N" + t[p + 1 :]
        rows.append((i, t.lower() if rnd.random() < 0.3 else t))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (5, rows[5][1]), (None, rows[5][1]), (102, None), (103, ""), (104, "A" * 500), (105, "a" * 130), (106, "AC" * 200), (107, "AC" * 90), (108, dna(20)), (109, dna(300) * 2)]
    return rows


@pytest.mark.parametrize(("n", "hot"), [(100, 50_000), (100, 3), (64, 50_000), (40, 2), (170, 50_000), (180, 4)])
def test_spans_equal_brute_force(spark, n, hot):
    rows = records()
    df = spark.createDataFrame([(r, s, 1, 2, 3, "x") for r, s in rows], SCHEMA).repartition(3)
    got = rlz_spans.shared_spans(df, min_len=n, block_pieces=20, hot_pieces=hot).collect()
    assert {tuple(r) for r in got} == brute(rows, n) and len(got) == len(set(got))


def test_long_spans(spark):
    rnd = random.Random(4)
    dna = lambda k: "".join(rnd.choice("ACGT") for _ in range(k))
    a = dna(2500)
    rows = [(1, dna(50) + a + dna(10)), (2, a[:900] + dna(5) + a[1000:]), (3, a[300:701]), (4, dna(1000))]
    df = spark.createDataFrame([(r, s, 1, 2, 3, "x") for r, s in rows], SCHEMA)
    for n in (400, 1000, 2000):
        assert {tuple(r) for r in rlz_spans.shared_spans(df, min_len=n).collect()} == brute(rows, n)


def test_copies_hold_a_third_of_all_rows(spark):
    rnd = random.Random(7)
    dna = lambda k: "".join(rnd.choice("ACGT") for _ in range(k))
    same = dna(150)
    rows = [(i, same) for i in range(200)] + [(1000 + i, dna(200)) for i in range(400)]
    df = spark.createDataFrame([(r, s, 1, 2, 3, "x") for r, s in rows], SCHEMA)
    assert {tuple(r) for r in rlz_spans.shared_spans(df, hot_pieces=10).collect()} == {(i, 0, 150) for i in range(200)}


def test_share_and_empty(spark):
    df = spark.createDataFrame([(1, "ACGT" * 40, 0, 0, 0, ""), (2, "ACGT" * 40, 0, 0, 0, ""), (3, None, 0, 0, 0, "")], SCHEMA)
    got = {r["x_id"]: (r["n_letters"], r["shared_letters"], r["shared_share"]) for r in rlz_spans.shared_share(df).collect()}
    assert got == {1: (160, 160, 1.0), 2: (160, 160, 1.0), 3: (0, 0, 0.0)}
    assert rlz_spans.shared_spans(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        rlz_spans.shared_spans(df, min_len=10)

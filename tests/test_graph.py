import random

from weftline.operators import graph as G

ARC = "u long, v long, len int, ol int"


def test_unitigs_and_circles(spark):
    # 2 -> 4 -> 6 branches to 8 and 10; 20 -> 22 -> 20 is a circle
    a = spark.createDataFrame([(2, 4, 10, 90), (4, 6, 20, 80), (6, 8, 5, 50), (6, 10, 5, 50), (20, 22, 1, 9), (22, 20, 1, 9)], ARC)
    got = {tuple(r) for r in G.unitigs(a).collect()}
    assert got == {(2, 6, 3, 30), (8, 8, 1, 0), (10, 10, 1, 0)}


def test_reduction_tips_bubbles(spark):
    a = spark.createDataFrame([(0, 2, 10, 90), (2, 4, 10, 90), (0, 4, 20, 80), (0, 6, 100, 70)], ARC)
    assert [tuple(r) for r in G.reducible(a, 5).collect()] == [(0, 4)]
    a = spark.createDataFrame([(0, 4, 1, 9), (2, 4, 1, 9), (4, 6, 1, 9)], ARC)
    assert {r[0] for r in G.tips(a, 1).collect()} == {0, 1, 2, 3}
    a = spark.createDataFrame([(0, 2, 1, 9), (0, 4, 1, 9), (2, 6, 1, 9), (4, 6, 1, 9)], ARC)
    assert [tuple(r) for r in G.simple_bubbles(a).collect()] == [(0, 6, 2, 4)]
    gone = spark.createDataFrame([(0, 2)], "u long, v long")
    both = spark.createDataFrame([(0, 2, 1, 9), (3, 1, 1, 9), (5, 7, 1, 9)], ARC)
    assert [tuple(r)[:2] for r in G.without(both, gone).collect()] == [(5, 7)]


def test_components_and_levels(spark):
    rnd = random.Random(9)
    e = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(e, "u long, v long")
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {(find(x), x) for p in e if p[0] != p[1] for x in p}
    assert {tuple(r) for r in G.components(df).collect()} == want
    assert G.components(df.where("false")).count() == 0
    start = spark.createDataFrame([(100,)], "node long")
    assert {tuple(r) for r in G.levels(df, start, 3).collect()} == {(100, 0), (101, 1), (102, 2), (103, 3)}

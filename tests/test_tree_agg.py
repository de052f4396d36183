import random

from weftline.operators import tree_agg
from weftline.operators.skew import hot_keys, join_unique

SCHEMA = "x long, rid long, pos int, n long, key string, side int, node int"


def brute(rows):
    out = set()
    for name, i, j in (("x", 0, 1), ("rid", 1, 0)):
        for k in {r[i] for r in rows if r[i] is not None}:
            own = [r for r in rows if r[i] == k]
            pos = [r[2] for r in own if r[2] is not None]
            out.add((name, k, len(own), len({r[j] for r in own if r[j] is not None}), min(pos, default=None), max(pos, default=None)))
    return out


def data(n=600):
    rnd = random.Random(5)
    rows = []
    for _ in range(n):
        x = 7 if rnd.random() < 0.4 else rnd.choice([None, *range(2**61, 2**61 + 40)])
        rid = 3 if rnd.random() < 0.4 else rnd.choice([None, *range(30)])
        rows.append((x, rid, rnd.choice([None, *range(1000)]), 1, "a", 9, 9))
    return rows + rows[:50]


def test_tree_equals_brute_force_at_every_depth(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for fan_in, chunk in ((2, 5), (4, 20), (16, 50_000)):
        got = {tuple(r) for r in tree_agg.tree_summary(df, "x", "rid", "pos", fan_in, chunk).collect()}
        assert got == brute(rows)


def test_hot_pair_and_share(spark):
    rows = [(1, 1, 5, 0, "", 0, 0)] * 49 + [(2, 2, 5, 0, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    s = tree_agg.tree_summary(df, "x", "rid", "pos", 2, 3)
    assert {tuple(r) for r in tree_agg.dominant_keys(s, 50).collect()} == {("x", 1), ("x", 2), ("rid", 1), ("rid", 2)}
    assert {tuple(r) for r in tree_agg.dominant_keys(s, 51).collect()} == {("x", 1), ("rid", 1)}


def test_empty_and_all_null(spark):
    assert tree_agg.tree_summary(spark.createDataFrame([], SCHEMA), "x", "rid", "pos").count() == 0
    assert tree_agg.tree_summary(spark.createDataFrame([(None, None, None, 0, "", 0, 0)], SCHEMA), "x", "rid", "pos").count() == 0


def test_join_unique_with_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (None, 1)], "k long, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    hot = hot_keys(left, "k", 53, share=0.1, floor=1)
    assert hot == [1]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, join_unique(left, right, "k", hot, how).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect()))

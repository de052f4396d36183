import random

import pytest

from weftline.llm import components

SCHEMA = "x_id long, y_id long, u string, v int, d int"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(find(x), x) for x in list(parent)}


@pytest.mark.parametrize("most", [30, 2])
def test_groups_equal_union_find(spark, most):
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)]
    pairs += [(500 + i, 501 + i) for i in range(60)]  # a long chain
    pairs += [(1000, 1001 + i) for i in range(120)]  # a hub with the highest degree
    pairs += [(1100, 1300), (1300, 1301), (1301, 1302), (1302, 7), (None, 3), (3, None), (None, None), (9, 9), (900, 900), (1000, 1001), (1001, 1000)]
    df = spark.createDataFrame([(a, b, "q", 1, 2) for a, b in pairs], SCHEMA)
    got = components.link_groups(df, "x_id", "y_id", most).collect()
    assert {tuple(r) for r in got} == brute(pairs) and len(got) == len(set(got))


def test_nothing_linked(spark):
    assert components.link_groups(spark.createDataFrame([], SCHEMA), "x_id", "y_id").count() == 0
    assert components.link_groups(spark.createDataFrame([(1, 1, "", 0, 0), (2, None, "", 0, 0)], SCHEMA), "x_id", "y_id").count() == 0

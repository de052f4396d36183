import random
import shutil
from collections import Counter, defaultdict

import numpy as np

from weftline.llm import count_sketch, seen_filter, term_bitmaps

SCHEMA = "mz_id long, x long, rid long, n long, val string, gen int"


def rows(n=3000, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x = 5 if rnd.random() < 0.34 else None if rnd.random() < 0.02 else rnd.choice([-3, 2**62 - 1, 2**61 + 1, 2**61 + 2]) if rnd.random() < 0.1 else int(rnd.expovariate(0.002))
        out.append((3 * i + rnd.randint(0, 2), x, rnd.choice([None, -5, *range(100)]), 1, "v", 0))
    rnd.shuffle(out)
    return out


def test_term_frequencies(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["field_name"], r["val"]): (r["n_rows"], r["n_records"], r["mark"]) for r in term_bitmaps.term_frequencies({"x": (df, "x", "rid"), "r": (df, "rid", "mz_id")}).collect()}
    want = {}
    for name, v, rec in (("x", 1, 2), ("r", 2, 0)):
        n, recs = Counter(), defaultdict(set)
        for r in data:
            if r[v] is not None:
                n[r[v]] += 1
                if r[rec] is not None:
                    recs[r[v]].add(r[rec])
        for k in n:
            d = len(recs[k])
            want[name, k] = (n[k], d, "rare" if d == 1 else "common" if d > 20 else None)
    assert got == want
    assert term_bitmaps.term_frequencies({"x": (df.where("false"), "x", "rid")}).count() == 0


def exact_seen(data):
    first = {}
    for i, x, *_ in data:
        if x is not None:
            first[x] = min(first.get(x, i), i)
    return {i for i, x, *_ in data if x is not None and i > first[x]}


def test_seen_before(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for first, shard, most in ((10**6, 10**6, 0), (100, 100, 6), (10, 500, 9)):
        got, status = seen_filter.seen_before(df, "x", "mz_id", first, shard_keys=shard)
        got = [r[0] for r in got.collect()]
        assert set(got) == exact_seen(data) and len(got) == len(set(got))
        assert status.agg({"probed": "max"}).first()[0] == most
    rep = seen_filter.error_report(df, "x", "mz_id").first()
    assert rep["wrongly_seen"] == rep["wrongly_new"] == 0 and 0 <= rep["measured_rate"] <= rep["compounded_bound"] < 1e-8
    assert seen_filter.seen_before(df.where("false"), "x", "mz_id")[0].count() == 0
    assert seen_filter.error_report(df.where("false"), "x", "mz_id").first()["n_rows"] == 0


def test_few_bits_show_their_error(spark):
    df = spark.range(40_000).selectExpr("id as mz_id", "xxhash64(id) as x")
    rep = seen_filter.error_report(df, "x", "mz_id", 200, bits=6).first()
    assert rep["wrongly_new"] == 0 and 0.3 * rep["compounded_bound"] < rep["measured_rate"] < rep["compounded_bound"] * 1.1


def test_stored_generations(spark, tmp_path):
    """Later batches are answered from stored filters alone: the tables of the earlier keys are gone by then."""
    data = sorted(rows(), key=lambda r: r[0])
    store = seen_filter.Store(spark, f"{tmp_path}/store")
    truth, said, rates = exact_seen(data), set(), []
    for k, (lo, hi, shard_keys) in enumerate(((0, 1200, 10**6), (1200, 1300, 40), (1300, 2600, 50), (2600, 3000, 10**6))):
        path = f"{tmp_path}/batch{k}"
        spark.createDataFrame(data[lo:hi], SCHEMA).write.parquet(path)
        got, rate = seen_filter.seen_in_store(spark.read.parquet(path), "x", "mz_id", store, shard_keys=shard_keys)
        ids = [r[0] for r in got.collect()]
        assert len(ids) == len(set(ids))
        said |= set(ids)
        rates.append(rate)
        shutil.rmtree(path)
    assert said == truth
    assert rates == [seen_filter.compounded_error(k) for k in range(4)] and store.batches() == [0, 1, 2, 3]
    assert set(store.filters().columns) == {"gen", "shards", "shard", "n", "bits", "seed", "slots"}
    none, rate = seen_filter.seen_in_store(spark.createDataFrame([], SCHEMA), "x", "mz_id", store)
    assert none.count() == 0 and store.batches() == [0, 1, 2, 3]


def test_xor_filter():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        k = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        f = seen_filter.XorFilter(k, 12)
        assert f.has(k).all()
        other = rng.integers(2**63, 2**64 - 1, 40_000, dtype=np.uint64)
        assert n == 0 or abs(f.has(other).mean() - 2**-12) < 4e-4
        assert f.nbytes <= 4 * (1.24 * n + 40)
    assert abs(seen_filter.compounded_error(10, 32) - 10 * 2**-32) < 1e-15


def test_top_values(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    n = Counter(r[1] for r in data if r[1] is not None)
    want = sorted(n.items(), key=lambda t: (-t[1], t[0]))[:10]
    got = count_sketch.top_values(df, "x").orderBy("rank").collect()
    assert [(r["val"], r["n_rows"]) for r in got] == want
    assert all(abs(r["approx_rows"] - r["n_rows"]) <= 5 for r in got)
    assert count_sketch.top_values(df.where("x is null"), "x").count() == 0
    assert count_sketch.top_values(df.where("x = 5"), "x").count() == 1


def test_partials_merge_in_rounds(spark):
    """10,000 partials: no merge group takes over FAN_IN of them, so none reads over 64 MB."""
    from pyspark.sql import functions as F

    cells = np.arange(count_sketch.BLOCK, dtype=np.int64)
    one = bytes(cells.tobytes())
    parts = spark.range(10_000, numPartitions=8).select(F.lit(3).alias("block"), F.col("id").cast("int").alias("node"), F.lit(bytearray(one)).alias("cells"))
    sizes = parts.groupBy(F.floor(F.col("node") / count_sketch.FAN_IN)).count().agg(F.max("count")).first()[0]
    assert sizes * len(one) <= 64 << 20
    got = count_sketch.merge_rounds(parts, 10_000).collect()
    assert len(got) == 1 and np.array_equal(np.frombuffer(got[0]["cells"], np.int64), 10_000 * cells)


def test_descent_says_when_it_may_have_missed_one(spark):
    flat = spark.range(50_000).selectExpr("id % 5000 as x")
    got = count_sketch.top_values(flat, "x", k=3, keep_factor=40, widen=0).collect()
    assert got and not any(r["sure"] for r in got)
    wide = count_sketch.top_values(spark.range(50_000).selectExpr("if(id % 2 = 0, 7, id) as x"), "x", k=1).collect()
    assert [(r["val"], r["sure"]) for r in wide] == [(7, True)]


def test_sketch_estimates_are_fair():
    h = count_sketch.Hierarchy(5, 10)
    rng = np.random.default_rng(1)
    v = rng.zipf(1.3, 100_000).astype(np.int64)
    h.add(v)
    vals, est, cut = h.descend(200)
    n = Counter(v.tolist())
    top = [x for x, _ in n.most_common(10)]
    assert set(top) <= set(vals.tolist())
    by = dict(zip(vals.tolist(), est.tolist()))
    assert all(abs(by[x] - n[x]) < 0.02 * len(v) for x in top)

import random
from collections import defaultdict

from weftline.llm import packing

SCHEMA = "doc_id long, text string, n int, part int, rank string"


def check(rows, sizes, cap):
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part"], r["token_start"], r["n_tokens"]))
    assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
    for d, p in parts.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p)))
        assert sum(x[2] for x in p) == sizes[d]
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:])) and p[0][1] == 0
        assert len(p) == max(1, -(-sizes[d] // cap))
        assert all(x[2] == cap for x in p[:-1])
    assert set(parts) == set(sizes)
    return len(fill), -(-sum(sizes.values()) // cap)


def test_rules_and_fill(spark, monkeypatch):
    rnd = random.Random(5)
    enc = packing.encoder(packing.VOCABULARY)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "Überzug", "7", "\n"]) for _ in range(rnd.choice([1, 3, 9, 20, 60, 200, 900]))) for i in range(300)}
    sizes = {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    data = [(i, t, 1, 2, "x") for i, t in texts.items()] + [(900, None, 0, 0, ""), (901, "", 0, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    for cap in (64, 256):
        for rank_rows in (200_000, 7):
            monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
            used, least = check(packing.pack(df, capacity=cap).collect(), sizes, cap)
            assert used <= 1.03 * least + 1
    s = packing.pack_summary(df, capacity=256).first()
    assert s["n_tokens"] == sum(sizes.values()) and s["fullest"] <= 256
    assert packing.pack(df.where("false")).count() == 0


def test_plan_covers_every_rank_once():
    rnd = random.Random(6)
    for _ in range(50):
        cap = rnd.randint(4, 60)
        hist = {n: rnd.randint(1, 40) for n in range(1, cap + 1) if rnd.random() < 0.5} or {1: 3}
        rows, total = packing.plan(hist, cap)
        load, seen = [0] * total, defaultdict(list)
        for n, a, b, at, per in rows.tolist():
            for rank in range(a, b):
                load[at + (rank - a) // per] += n
                seen[n].append(rank)
        assert all(sorted(seen[n]) == list(range(k)) for n, k in hist.items())
        assert max(load) <= cap and min(load) > 0
        assert total <= 1.7 * (-(-sum(n * k for n, k in hist.items()) // cap)) + 1
        big = [n for n in hist if n > cap // 2]
        assert total >= sum(hist[n] for n in big)


def test_repeated_ids_and_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 50_000, 0, 0, ""), (2, "a", 0, 0, ""), (2, "a", 0, 0, "")], SCHEMA)
    rows = packing.pack(df).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["n_tokens"] for r in rows if r["doc_id"] == 1) >= 50_000

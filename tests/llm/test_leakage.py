import random

import numpy as np

from weftline.llm import leakage
from weftline.llm.words import words

D, I = "doc_id long, text string, item_id int, d string", "item_id long, item_text string, text int"


def brute(doc, item):
    """Some stretch of 20 to 60 item words, ends kept, with at most one edit in six."""
    for a in range(len(item) - 19):
        prev = [0 if True else 0] * (len(doc) + 1)
        prev = [0] * (len(doc) + 1)
        first = True
        for n, w in enumerate(item[a : a + 60], 1):
            kept = [10**6] + [prev[j] if doc[j] == w else 10**6 for j in range(len(doc))]
            if n >= 20 and min(kept) * 6 <= n:
                return True
            cur = [10**6] * (len(doc) + 1)
            for j in range(len(doc) + 1):
                if first:
                    cur[j] = kept[j]
                else:
                    cur[j] = min(prev[j] + 1, kept[j], (prev[j - 1] + 1) if j else 10**6)
                if j:
                    cur[j] = min(cur[j], cur[j - 1] + 1)
            first = False
            prev = cur
    return False


def edited(rnd, ws, rate, vocab):
    out = []
    for w in ws:
        x = rnd.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(rnd.choice(vocab))
            continue
        out.append(w)
        if x > 1 - rate / 3:
            out.append(rnd.choice(vocab))
    return out


def test_leaks_equal_brute_force():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    seen, got_sim = {True: 0, False: 0}, 0
    for k in range(250):
        item = [rnd.choice(vocab) for _ in range(rnd.randint(20, 70))]
        a = rnd.randint(0, len(item) - 1)
        quote = edited(rnd, item[a : a + rnd.randint(12, 45)], rnd.choice([0, 0.1, 0.17, 0.25]), vocab)
        doc = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))] + quote + [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        ix = leakage.SimIndex([(7, " ".join(item))]) if k % 5 == 0 else leakage.ItemIndex([(7, " ".join(item))])
        want = brute(doc, item)
        assert leakage._search(ix, [1], [" ".join(doc)], True) == (([1], [7]) if want else ([], [])), (k, want)
        if k % 5 == 0:
            # all words are known and drawn from 60 here, the hardest noise for fingerprints
            found = leakage._search(ix, [1], [" ".join(doc)])
            assert want or found == ([], [])
            got_sim += found == ([1], [7])
        seen[want] += 1
    assert min(seen.values()) > 30 and got_sim > 10


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 60))) for i in range(8)]
    ix = leakage.SimIndex(texts)
    for _ in range(300):
        k = int(rng.integers(0, len(ix.prints)))
        flips = rng.choice(64, int(rng.integers(0, leakage.RADIUS + 1)), replace=False)
        f = ix.prints[k] ^ np.bitwise_or.reduce(np.append(np.uint64(1) << flips.astype(np.uint64), np.uint64(0)))
        hit = False
        for (shift, bits), (first, entry) in zip(leakage.BIT_BLOCKS, ix.tables):
            key = int((f >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
            hit |= k in entry[first[key] : first[key + 1]].tolist()
        assert hit


def test_recall_on_planted_quotes(spark):
    rnd = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    items = [[rnd.choice(vocab) for _ in range(80)] for _ in range(20)]
    docs = []
    for k in range(200):
        it = items[k % 20]
        a = rnd.randint(0, 50)
        quote = edited(rnd, it[a : a + rnd.randint(22, 30)], 0.09, vocab)
        docs.append((k, " ".join([rnd.choice(vocab) for _ in range(50)] + quote + [f"other{rnd.random()}" for _ in range(30)]), 0, ""))
    r = leakage.recall(spark.createDataFrame(docs, D), spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)], I)).first()
    assert r["n_exhaustive"] > 100 and r["recall"] >= 0.95 and r["n_found"] <= r["n_exhaustive"]


def test_forms_do_not_count(spark):
    rnd = random.Random(3)
    base = [f"Zu{c}öner{i}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    passage = " ".join(base)
    import unicodedata

    forms = {
        1: passage.upper(), 2: ",\n".join(base), 3: " ".join(w[:2] + "​" + w[2:] for w in base), 4: " <b>x</b> ".join(["intro", passage]).replace("<b>x</b>", "<br>"), 5: unicodedata.normalize("NFD", passage),
        6: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in passage), 7: passage.replace(" ", "&nbsp;"), 8: "\x00".join(passage), 9: " ".join(w + "." for w in base),
    }
    shuffled = base[:]
    rnd.shuffle(shuffled)
    bad = {20: " ".join(shuffled), 21: " ".join(base[:15]), 22: " ".join(w if i % 3 else "other" for i, w in enumerate(base)), 23: None, 24: "", 25: "x" * 100_000}
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in {**forms, **bad}.items()] + [(None, passage, 1, "z"), (1, passage, 1, "z")], D)
    items = spark.createDataFrame([(70, "Answer.\n" + passage + "\nWhy?", 0), (71, passage, 0), (72, None, 0), (73, "", 0), (None, passage, 0)], I)
    got = leakage.leaked_items(docs, items).collect()
    assert {tuple(r) for r in got} == {(k, i) for k in forms for i in (70, 71)} and len(got) == 2 * len(forms)
    assert leakage.leaked_items(docs.where("false"), items).count() == 0
    assert leakage.leaked_items(docs, items.where("false")).count() == 0


def test_item_blocks_pass_by_one_scan(spark, monkeypatch, tmp_path):
    """Twenty blocks of items and more: the corpus is read once, whatever is held at a time."""
    ps = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(40)]
    spark.createDataFrame([(k, p, 0, "") for k, p in enumerate(ps)], D).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(k, p, 0) for k, p in enumerate(ps)], I)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert len(leakage.pack_items(list(enumerate(ps)))) >= 20
    for held in (1, 10**6):
        monkeypatch.setattr(leakage, "HELD_WORDS", held)
        df = leakage.leaked_items(docs, items)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {tuple(r) for r in df.collect()} == {(k, k) for k in range(40)}
    monkeypatch.setattr(leakage, "GROUP_CHARS", 2000)
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == {(k, k) for k in range(40)}


def test_words():
    assert words("Don’t STOP — ﬁne&amp;dandy­!") == words("don't stop: fine dandy") and words(None) == [] and words("") == []
    assert np.array_equal(leakage.run_codes(np.arange(3)), np.zeros(0, np.uint64))

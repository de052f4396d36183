"""Chains of long and of many pairs against chains taken one by one, each worked out anew."""

import numpy as np
import pytest

from weftline.kernels import chain


def one_by_one(q, t, w, least, r):
    left, out = np.arange(len(q)), []
    while len(left):
        s, path = chain.chain(q[left], t[left], w[left], r)
        if out and s < least * out[0][0]:
            break
        out.append((s, [int(left[i]) for i in path]))
        left = np.delete(left, path)
    return out


@pytest.mark.parametrize("look", [1, 2, 5, 20, 5000])
def test_chains_as_worked_out_anew(look):
    rnd = np.random.default_rng(look)
    for k in range(40):
        n, span = int(rnd.integers(1, 60)), int(rnd.choice([20, 60, 300, 2000]))
        q = rnd.integers(0, span, n)
        t = rnd.integers(-span, span, n) if k % 2 else q + rnd.integers(-20, 20, n)
        w = rnd.integers(1, 4, n) if k % 3 == 0 else np.ones(n, np.int64)
        r = chain.ChainRule(max_look=look, max_dist=int(rnd.choice([10, 100, 5000])), band=float(rnd.choice([0.05, 0.5])))
        least = float(rnd.choice([0.1, 0.5, 0.9]))
        assert chain.chains(q, t, w, least, r) == one_by_one(q, t, w, least, r)


def test_many_pairs_at_once():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 30):
        q = rnd.integers(0, 500, (50, n))
        t = np.where(np.arange(50)[:, None] % 2, rnd.integers(-500, 500, (50, n)), q + rnd.integers(-20, 20, (50, n)))
        score, on, k = chain.chains_of_many(q, t, 0.5)
        for i in range(50):
            want = one_by_one(q[i], t[i], np.ones(n, np.int64), 0.5, chain.ChainRule())
            assert (score[i], np.flatnonzero(on[i]).tolist(), k[i]) == (want[0][0], sorted(want[0][1]), len(want))


def test_a_chain_taken_does_not_start_all_over(monkeypatch):
    def never(*_):
        raise AssertionError("worked out anew")

    monkeypatch.setattr(chain, "chain", never)
    q = np.arange(1000) * 7 % 997
    assert len(chain.chains(q, np.arange(1000), np.ones(1000, np.int64), 0.5)) > 1

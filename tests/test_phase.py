import itertools
import random

import numpy as np

from weftline.kernels import maxcut
from weftline.kernels.random import Stream
from weftline.options import Options
from weftline.plans import advanced


def grid(side):
    """A frustrated signed torus: two edges a node, many local optima."""
    rnd = random.Random(7)
    at = lambda x, y: x % side * side + y % side
    e = [(at(x, y), b) for x in range(side) for y in range(side) for b in (at(x + 1, y), at(x, y + 1))]
    w = [float(rnd.choice([-1, 1]) * rnd.randint(1, 9)) for _ in e]
    u, v = np.array([min(p) for p in e]), np.array([max(p) for p in e])
    return u, v, np.array(w)


def test_draws_at_once():
    a, b = Stream(5), Stream(5)
    assert [a.uniform() for _ in range(9)] == b.uniforms(9).tolist() and a.uniform() == b.uniform()


def test_large_component_is_solved_as_any_other(spark):
    """22,472 edges, over the old limit of the kernel: no node moves, and the perturbations are those of the options."""
    u, v, w = grid(106)
    n, o = 106 * 106, Options()
    got = dict(advanced.phase(spark.createDataFrame(list(zip(u.tolist(), v.tolist(), w.tolist())), "u long, v long, w double")).select("rid", "spin").collect())
    s = np.array([got[i] for i in range(n)])
    z = np.bincount(u, w * s[v], n) + np.bincount(v, w * s[u], n)
    assert not (s * z > 0).any()
    k = np.lexsort((v, u))
    assert maxcut.score(s, u, v, w) > maxcut.score(maxcut.solve(n, u[k], v[k], w[k], o.seed, 200), u, v, w)


def test_optimum_by_elimination():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(2, 8)
        e = [p for p in itertools.combinations(range(n), 2) if rnd.random() < 0.5] or [(0, 1)]
        u, v, w = np.array([a for a, _ in e]), np.array([b for _, b in e]), np.array([rnd.choice([-3.0, -1.0, 1.0, 2.0]) for _ in e])
        assert maxcut.optimum(n, u, v, w) == max(maxcut.score(np.array(s), u, v, w) for s in itertools.product((-1, 1), repeat=n))

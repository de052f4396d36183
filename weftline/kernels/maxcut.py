"""Two-sided assignment of the nodes of one component (max-cut with signed weights)."""

from __future__ import annotations

import heapq

import numpy as np

from .random import Stream


def score(spin: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Weight cut less weight kept, over all edges; a positive weight asks for opposite sides."""
    return float(-(spin[u] * spin[v] * w).sum())


def optimum(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, width: int = 14) -> float:
    """The best score of any spins, by elimination of the node with the fewest neighbours; the sum of all weights (a bound) where one has over ``width``."""
    near: list[set[int]] = [set() for _ in range(n)]
    tables: list[list] = [[] for _ in range(n)]  # of each node: [nodes, score by their sides, used up]
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
        near[a].add(b)
        near[b].add(a)
        t = [(a, b), np.array([[-x, x], [x, -x]]), False]
        tables[a].append(t)
        tables[b].append(t)
    heap = [(len(k), x) for x, k in enumerate(near)]
    heapq.heapify(heap)
    total, done = 0.0, [False] * n
    while heap:
        k, x = heapq.heappop(heap)
        if done[x] or k != len(near[x]):
            continue
        if k > width:
            return float(np.abs(w).sum())
        done[x] = True
        axes = {y: i for i, y in enumerate([*sorted(near[x]), x])}
        tab = np.zeros((2,) * (k + 1))
        for t in tables[x]:
            if t[2]:
                continue
            t[2] = True
            by = np.argsort([axes[y] for y in t[0]])
            have = {axes[y] for y in t[0]}
            tab = tab + t[1].transpose(by).reshape([2 if i in have else 1 for i in range(k + 1)])
        tab = tab.max(axis=-1)
        if not k:
            total += float(tab)
            continue
        new = [tuple(sorted(near[x])), tab, False]
        for y in near[x]:
            near[y] |= near[x]
            near[y] -= {x, y}
            tables[y] = [t for t in tables[y] if not t[2]] + [new]
            heapq.heappush(heap, (len(near[y]), y))
        tables[x] = []
    return total


def solve(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: int = 11, rounds: int = 200, rate: float = 0.1) -> np.ndarray:
    """Spins of nodes 0..n-1: greedy start by heaviest edge, local flips, then seeded perturbations kept if better.

    Node 0 ends on side +1. Nodes without edges stay 0. Perturbations end early only once the
    score is the best there is, as nothing better can be kept then.
    """
    rnd = Stream(seed)
    nbr: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
        nbr[a].append((b, x))
        nbr[b].append((a, x))
    spin, z = [0] * n, [0.0] * n  # z: the pull of the neighbours, weight towards +1 less weight towards -1
    for e in np.lexsort((v, u, -np.abs(w))):
        for x in (int(u[e]), int(v[e])):
            if not spin[x]:
                spin[x] = t = -1 if z[x] > 0 else 1
                for y, k in nbr[x]:
                    z[y] += t * k

    def flip(s: list, z: list, x: int, wrong: set) -> float:
        """Moves x, adds the neighbours that want to move now to ``wrong``; returns what the score gains."""
        gain, t = 2 * s[x] * z[x], -2 * s[x]
        s[x] = -s[x]
        for y, k in nbr[x]:
            z[y] += t * k
            if s[y] * z[y] > 0:
                wrong.add(y)
        return gain

    def settle(s: list, z: list, wrong: set) -> float:
        """Flips in random order until no node moves; each raises the score, so this ends."""
        gain = 0.0
        while todo := sorted(x for x in wrong if s[x] * z[x] > 0):
            wrong = set()
            for i in np.argsort(rnd.uniforms(len(todo)), kind="stable").tolist():
                if s[todo[i]] * z[todo[i]] > 0:
                    gain += flip(s, z, todo[i], wrong)
        return gain

    settle(spin, z, set(range(n)))
    best, most = -sum(a * b for a, b in zip(spin, z)) / 2, float(np.abs(w).sum())
    if best < most and n > 2 and rounds:
        most = optimum(n, u, v, w)
    for k in range(rounds if n > 2 else 0):
        if best >= most:
            break
        if k % 2:
            nodes = np.flatnonzero(rnd.uniforms(n) < rate).tolist()
        else:  # a ball around a node, three steps wide; no further step once it holds more than that share
            edge = nodes = {int(rnd.uniform() * n)}
            for _ in range(3):
                edge = {y for x in edge for y, _ in nbr[x]} - nodes
                nodes = nodes | edge
                if len(nodes) > int(n * rate) > 0:
                    break
        s, y, wrong = spin.copy(), z.copy(), set()
        gain = sum(flip(s, y, x, wrong) for x in nodes)
        gain += settle(s, y, wrong | set(nodes))
        if gain > 0:
            spin, z, best = s, y, best + gain
    return np.array(spin, np.int64) * (spin[0] or 1)

"""Collinear chaining of seed hits and longest increasing subsequences on one pair of records."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChainRule:
    """Limits and penalties of the chaining score."""

    span: int = 21
    band: float = 0.05
    gap: float = 0.5 * math.exp(-0.1 * 21)
    skip: float = 0.0005 * math.exp(-0.1 * 21)
    max_dist: int = 5000
    max_look: int = 5000
    max_skip: int = 25


def pair_score(dq: np.ndarray, dt: np.ndarray, weight: np.ndarray, total: np.ndarray, r: ChainRule) -> np.ndarray:
    """Gain of putting an anchor behind another; -inf where they don't fit."""
    lo, dd = np.minimum(dq, dt), np.abs(dq - dt)
    bad = (dq <= 0) | (dt <= 0) | (dq > r.max_dist) | (dt > r.max_dist) | ((dd > 16) & (dd > r.band * total))
    s = np.floor(np.minimum(r.span, lo) / weight)
    lo_safe = np.maximum(lo, 1)
    cost = np.minimum(r.gap * dd, s * (dd / lo_safe) / r.band) + r.skip * lo
    s = s - np.where((dd > 0) | (lo > r.span), np.floor(cost), 0)
    return np.where(bad, -np.inf, s)


def chain(q: np.ndarray, t: np.ndarray, w: np.ndarray, r: ChainRule = ChainRule()) -> tuple[float, list[int]]:
    """(score, anchors in order) of the best chain; ties go to the earlier end."""
    n = len(q)
    if not n:
        return 0.0, []
    o = np.lexsort((q, t))
    q, t, w = q[o].astype(np.int64), t[o].astype(np.int64), np.maximum(w[o], 1)
    own = np.floor(r.span / w)
    f, back, first = own.astype(float).copy(), np.full(n, -1), np.arange(n)
    for i in range(1, n):
        a = max(0, i - r.max_look)
        dq, dt = q[i] - q[a:i], t[i] - t[a:i]
        total = np.maximum(t[i] - t[first[a:i]], 1)
        g = f[a:i] + pair_score(dq, dt, w[i], total, r)
        k = len(g) - 1 - int(np.argmax(g[::-1]))
        if g[k] > f[i]:
            f[i], back[i], first[i] = g[k], a + k, first[a + k]
    end = int(np.argmax(f))
    path = []
    i = end
    while i >= 0:
        path.append(int(o[i]))
        i = int(back[i])
    return float(f[end]), path[::-1]


def chains(q: np.ndarray, t: np.ndarray, w: np.ndarray, least: float, r: ChainRule = ChainRule()) -> list[tuple[float, list[int]]]:
    """Chains taken one after the other until none scores ``least`` of the first.

    The scores are worked out once. Taking a chain away touches only anchors behind it, and of
    these only the ones that change are worked out again, so the chains are those of a new
    ``chain`` over what is left.
    """
    n = len(q)
    if not n:
        return []
    o = np.lexsort((q, t))
    q, t, w = q[o].astype(np.int64), t[o].astype(np.int64), np.maximum(w[o], 1)
    own = np.floor(r.span / w)
    f, back, first = own.astype(float).copy(), np.full(n, -1), np.arange(n)
    near, same = np.searchsorted(t, t - r.max_dist, "left"), np.searchsorted(t, t, "left")
    behind, far = np.searchsorted(t, t, "right"), np.searchsorted(t, t + r.max_dist, "right")
    start = np.maximum(np.arange(n) - r.max_look, 0)

    skew = t - q

    def fits(i, j):
        """Whether the band lets j stand before i: few do, and the others cost no more than this."""
        dd = np.abs(skew[i] - skew[j])
        return (dd <= 16) | (dd <= r.band * np.maximum(t[i] - t[first[j]], 1))

    def gain(i, j):
        """f of j and ``pair_score`` of what stands in order and fits."""
        lo, dd = np.minimum(q[i] - q[j], t[i] - t[j]), np.abs(skew[i] - skew[j])
        s = np.floor(np.minimum(r.span, lo) / w[i])
        cost = np.floor(np.minimum(r.gap * dd, s * (dd / lo) / r.band) + r.skip * lo)
        return f[j] + (s - (cost if r.skip * r.span < 1 else np.where((dd > 0) | (lo > r.span), cost, 0)))

    def pull(i: int) -> bool:
        """The best anchor before i; whether that changes anything for those behind i."""
        was = f[i], first[i]
        f[i], back[i], first[i] = own[i], -1, i
        a = max(start[i], near[i])
        dq = q[i] - q[a : same[i]]
        j = a + np.flatnonzero((dq > 0) & (dq <= r.max_dist))
        j = j[fits(i, j)]
        if len(j):
            g = gain(i, j)
            k = len(g) - 1 - int(np.argmax(g[::-1]))
            if g[k] > f[i]:
                f[i], back[i], first[i] = g[k], j[k], first[j[k]]
        return was != (f[i], first[i])

    for i in range(1, n):
        pull(i)
    out: list[tuple[float, list[int]]] = []
    alive, left = np.ones(n, bool), n
    while left:
        end = int(np.argmax(f))
        if out and f[end] < least * out[0][0]:
            break
        path, i = [], end
        while i >= 0:
            path.append(i)
            i = int(back[i])
        out.append((float(f[end]), [int(o[i]) for i in path[::-1]]))
        alive[path], f[path], left = False, -np.inf, left - len(path)
        anew, changed = np.zeros(n, bool), np.zeros(n, bool)  # to be worked out from all before it; other than before the chain went
        todo = path[:]
        if n > r.max_look and left:  # the places set free let each anchor look further back
            there = np.flatnonzero(alive)
            now = start.copy()
            now[there] = there[np.maximum(np.arange(left) - r.max_look, 0)]
            lo = np.maximum(now, near)
            m = np.maximum(np.minimum(start, same) - lo, 0) * alive
            i = np.repeat(np.arange(n), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + lo[i]
            start = now
            ok = alive[j] & (q[i] > q[j]) & (q[i] <= q[j] + r.max_dist) & fits(i, j)
            i, j = i[ok], j[ok]
            i = np.unique(i[gain(i, j) > f[i]])
            anew[i] = True
            todo += i.tolist()
        heapq.heapify(todo)
        last = -1
        while todo:
            j = heapq.heappop(todo)
            if j == last:
                continue
            last = j
            if anew[j] and not (pull(j) | changed[j]):
                continue
            a, e = behind[j], far[j]
            i = a + np.flatnonzero(alive[a:e] & (q[a:e] > q[j]) & (q[a:e] <= q[j] + r.max_dist))
            if not len(i):
                continue
            on = i[back[i] == j]
            anew[on] = True
            for x in on.tolist():
                heapq.heappush(todo, x)
            if alive[j]:
                i = i[(start[i] <= j) & fits(i, j)]
                g = gain(i, j)
                up = (g > f[i]) | ((g == f[i]) & (back[i] >= 0) & (back[i] < j))
                i, g = i[up], g[up]
                moved = (g != f[i]) | (first[i] != first[j])
                f[i], back[i], first[i] = g, j, first[j]
                changed[i[moved]] = True
                for x in i[moved].tolist():
                    heapq.heappush(todo, x)
    return out


def chains_of_many(q: np.ndarray, t: np.ndarray, least: float, r: ChainRule = ChainRule()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``chains`` of many pairs with equally many anchors (a row each, weights 1): score and anchors (a mask) of the first chain, number of chains.

    For short rows: it holds all links of all pairs, and no look-back limit is reached.
    """
    p, n = q.shape
    if n > r.max_look:
        raise ValueError("too many anchors")
    o = np.argsort((t << 32) + q, axis=1, kind="stable")
    q, t = np.take_along_axis(q, o, 1), np.take_along_axis(t, o, 1)
    dq, dt = q[:, :, None] - q[:, None, :], t[:, :, None] - t[:, None, :]
    dd = np.abs(dq - dt)
    link = pair_score(dq, dt, 1, np.array(np.inf), r)  # but for the band, which depends on the chain
    score, n_chains, taken = np.zeros(p), np.zeros(p, np.int64), np.zeros((p, n), bool)
    alive, rows = np.ones((p, n), bool), np.arange(p)
    while len(rows):
        m = np.arange(len(rows))
        f = np.where(alive, float(math.floor(r.span)), -np.inf)
        back, first = np.full((len(rows), n), -1), t.copy()  # first: its place
        for i in range(1, n):
            d = dd[:, i, :i]
            total = np.maximum(t[:, i, None] - first[:, :i], 1)
            g = f[:, :i] + np.where((d > 16) & (d > r.band * total), -np.inf, link[:, i, :i])
            k = i - 1 - np.argmax(g[:, ::-1], axis=1)
            best = g[m, k]
            up = alive[:, i] & (best > f[:, i])
            f[:, i] = np.where(up, best, f[:, i])
            back[:, i] = np.where(up, k, -1)
            first[:, i] = np.where(up, first[m, k], first[:, i])
        end = np.argmax(f, axis=1)
        s = f[m, end]
        new = n_chains[rows] == 0
        score[rows[new]] = s[new]
        on = (s > -np.inf) & (new | (s >= least * score[rows]))
        m, i = m[on], end[on]
        path = np.zeros((len(rows), n), bool)
        while len(m):
            path[m, i] = True
            i = back[m, i]
            m, i = m[i >= 0], i[i >= 0]
        taken[rows[new]] = path[new]
        n_chains[rows[on]] += 1
        alive &= ~path
        on &= alive.any(axis=1)
        rows, alive, t, dd, link = rows[on], alive[on], t[on], dd[on], link[on]
    mask = np.zeros((p, n), bool)
    np.put_along_axis(mask, o, taken, 1)
    return score, mask, n_chains


def increasing(values: list[int]) -> int:
    """Length of the longest strictly increasing subsequence."""
    tails: list[int] = []
    for v in values:
        i = bisect_left(tails, v)
        tails[i : i + 1] = [v]
    return len(tails)

"""Edit scripts of many pairs at once: a banded table over the whole batch, traced back side by side.

Of all shortest scripts the one is taken that leaves, seen from the end, the target as late as it
can: query letters are given up first, then letters are paired, then target letters are added.
"""

from __future__ import annotations

import numpy as np

from .align import MATCH, MISMATCH, MORE_QUERY, MORE_TARGET

#: Cells of the table of one sub-batch (2 bytes each).
CELLS = 1 << 23


def scripts(queries: list[str], targets: list[str], dists: list[int]) -> list[np.ndarray]:
    """The operations of each pair from start to end; ``dists`` are the edit distances, which bound the bands."""
    m = np.array([len(x) for x in queries], np.int64)
    d = np.array(dists, np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(m)
    order = np.lexsort((m, d))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        top = m[order[lo]]
        while hi < len(order):
            top2 = max(top, m[order[hi]])
            if (hi + 1 - lo) * (top2 + 1) * (2 * d[order[hi]] + 1) > CELLS:
                break
            top, hi = top2, hi + 1
        part = order[lo:hi]
        for i, ops in zip(part, _batch([queries[i] for i in part], [targets[i] for i in part], int(d[part].max()))):
            out[i] = ops
        lo = hi
    return out


def _batch(qs: list[str], ts: list[str], k: int) -> list[np.ndarray]:
    p = len(qs)
    m, n = np.array([len(x) for x in qs]), np.array([len(x) for x in ts])
    rows = int(m.max(initial=0))
    width = 2 * k + 1
    q = np.zeros((p, rows + 1), np.uint8)
    t = np.full((p, rows + 2 * k + 2), 255, np.uint8)  # t[:, j + k] is letter j (1-based) less one
    for i, (x, y) in enumerate(zip(qs, ts)):
        q[i, : len(x)] = np.frombuffer(x.encode("latin1", "replace"), np.uint8)
        y = np.frombuffer(y.encode("latin1", "replace"), np.uint8)[: rows + k + 1]
        t[i, k + 1 : k + 1 + len(y)] = y
    big = np.int16(1 << 14) if k < 1 << 13 else np.int32(1 << 28)
    kind = big.dtype
    band = np.arange(width, dtype=kind)
    table = np.empty((rows + 1, p, width), kind)
    table[0] = np.where(band >= k, band - k, big)
    for i in range(1, rows + 1):
        prev = table[i - 1]
        j = np.arange(i - k, i + k + 1)
        # cell d stands for target letters j = i + d - k
        cur = prev + (t[:, i : i + width] != q[:, i - 1 : i])
        cur[:, :-1] = np.minimum(cur[:, :-1], prev[:, 1:] + 1)
        cur = np.where((j < 0)[None, :], big, cur)
        if 0 <= k - i < width:
            cur[:, k - i] = i
        table[i] = np.minimum(np.minimum.accumulate(cur - band, axis=1) + band, big)
    i, dd = m.copy(), n - m + k
    ops = np.zeros((p, int((m + n).max(initial=0))), np.uint8)
    at = np.zeros(p, np.int64)
    who = np.arange(p)
    while True:
        j = i + dd - k
        live = who[(i[who] > 0) | (j[who] > 0)]
        if not len(live):
            break
        a, b, jj = i[live], dd[live], j[live]
        here = table[a, live, b].astype(np.int64)
        up = np.where((a > 0) & (b + 1 < width), table[np.maximum(a - 1, 0), live, np.minimum(b + 1, width - 1)], big) + 1 == here
        same = q[live, np.maximum(a - 1, 0)] == t[live, np.maximum(jj, 0) + k]
        diag = (a > 0) & (jj > 0) & (table[np.maximum(a - 1, 0), live, b] + ~same == here)
        op = np.where(up, MORE_QUERY, np.where(diag, np.where(same, MATCH, MISMATCH), MORE_TARGET)).astype(np.uint8)
        ops[live, at[live]] = op
        at[live] += 1
        i[live] -= op != MORE_TARGET
        dd[live] += np.where(op == MORE_QUERY, 1, np.where(op == MORE_TARGET, -1, 0))
        who = live
    return [ops[x, : at[x]][::-1] for x in range(p)]


def runs(ops: np.ndarray) -> list[tuple[int, int]]:
    """(operation, length) of the runs of a script."""
    if not len(ops):
        return []
    cut = np.flatnonzero(np.r_[True, ops[1:] != ops[:-1]])
    return list(zip(ops[cut].tolist(), np.diff(np.append(cut, len(ops))).tolist()))


def differences(query: str, target: str, ops: np.ndarray) -> list[tuple[int, str, str]]:
    """(query offset, own letter, other): changed letters, ``-`` for a letter that the target lacks, and ``+text`` with an empty own letter for text before that offset.

    Text beyond either end of the query is no difference: nothing holds it from that side.
    """
    out = []
    i = j = 0
    for op, n in runs(ops):
        if op == MISMATCH:
            out += [(i + x, query[i + x], target[j + x]) for x in range(n)]
        elif op == MORE_QUERY:
            out += [(i + x, query[i + x], "-") for x in range(n)]
        elif op == MORE_TARGET and 0 < i < len(query):
            out.append((i, "", "+" + target[j : j + n]))
        i += n if op != MORE_TARGET else 0
        j += n if op != MORE_QUERY else 0
    return out


def boundaries(ops: np.ndarray) -> np.ndarray:
    """Target letters used up once 0, 1, 2, ... query letters are, with what is added behind them."""
    used = np.concatenate([[0], np.cumsum(ops != MORE_QUERY)])
    return used[np.append(np.flatnonzero(ops != MORE_TARGET), len(ops))]  # right before the next step of the query

"""Consensus of a few short texts over one disputed range: a partial-order alignment graph."""

from __future__ import annotations

import numpy as np


def consensus(texts: list[str], counts: list[int] | None = None, match: int = 2, mismatch: int = -4, gap: int = -3) -> str:
    """The heaviest path through the alignment graph of the texts, the first of them as backbone.

    Texts are added in order, each once with its count as weight; an empty list gives an empty text.
    """
    counts = [k for t, k in zip(texts, counts or [1] * len(texts)) if t]
    texts = [t for t in texts if t]
    if not texts:
        return ""
    base = list(texts[0])
    inn: list[dict[int, int]] = [{} for _ in base]
    weight = [counts[0]] * len(base)
    alike: list[list[int]] = [[] for _ in base]
    for i in range(1, len(base)):
        inn[i][i - 1] = counts[0]
    for text, times in zip(texts[1:], counts[1:]):
        order = _topological(inn)
        rank = {x: k for k, x in enumerate(order)}
        m = len(text)
        t = np.array(list(text))
        j = np.arange(m + 1)
        best = np.zeros((len(order) + 1, m + 1))
        best[0] = gap * j
        move = np.zeros((len(order) + 1, m + 1), np.int8)
        frm = np.zeros((len(order) + 1, m + 1), np.int64)
        for k, x in enumerate(order, 1):
            pred = [rank[p] + 1 for p in inn[x]] or [0]
            sub = np.where(t == base[x], match, mismatch)
            cand = np.stack([best[p] for p in pred])
            which = cand.argmax(axis=0)
            up = cand.max(axis=0) + gap
            dg = np.full(m + 1, -1e9)
            dg[1:] = cand.max(axis=0)[:-1] + sub
            row = np.maximum(up, dg)
            run = np.maximum.accumulate(row - gap * j) + gap * j
            best[k] = run
            move[k] = np.where(run > row, 2, np.where(dg >= up, 0, 1))
            pr = np.array(pred)
            frm[k] = pr[which]
            frm[k][1:] = np.where(move[k][1:] == 0, pr[which[:-1]], frm[k][1:])
        ends = [rank[x] + 1 for x in range(len(base)) if not any(x in p for p in inn)]
        k = max(ends, key=lambda e: best[e, m])
        jj, path = m, []
        while k > 0 or jj > 0:
            if k == 0:
                path.append((None, jj - 1))
                jj -= 1
            elif move[k, jj] == 2:
                path.append((None, jj - 1))
                jj -= 1
            elif move[k, jj] == 0 and jj > 0:
                path.append((order[k - 1], jj - 1))
                k, jj = int(frm[k, jj]), jj - 1
            else:
                k = int(frm[k, jj])
        prev = None
        for node, at in reversed(path):
            ch = text[at]
            cur = None
            if node is not None:
                cur = next((y for y in [node, *alike[node]] if base[y] == ch), None)
            if cur is None:
                cur = len(base)
                base.append(ch)
                inn.append({})
                weight.append(0)
                alike.append([])
                if node is not None:
                    group = [node, *alike[node]]
                    alike[cur] = list(group)
                    for y in group:
                        alike[y].append(cur)
            weight[cur] += times
            if prev is not None:
                inn[cur][prev] = inn[cur].get(prev, 0) + times
            prev = cur
    order = _topological(inn)
    gain, back = {}, {}
    half = sum(counts) / 2
    for x in order:
        p = max(inn[x], key=lambda y: (gain[y], inn[x][y]), default=None)
        gain[x] = weight[x] - half + (max(gain[p], 0) if p is not None else 0)
        back[x] = p if p is not None and gain[p] > 0 else None
    x = max(order, key=lambda y: gain[y])
    out = []
    while x is not None:
        out.append(base[x])
        x = back[x]
    return "".join(reversed(out))


def _topological(inn: list[dict[int, int]]) -> list[int]:
    outs: list[list[int]] = [[] for _ in inn]
    need = [len(p) for p in inn]
    for x, p in enumerate(inn):
        for y in p:
            outs[y].append(x)
    ready = [x for x, k in enumerate(need) if not k]
    order = []
    while ready:
        x = ready.pop()
        order.append(x)
        for y in outs[x]:
            need[y] -= 1
            if not need[y]:
                ready.append(y)
    return order

"""Sequence alignment on single pairs: bit-parallel edit distance with trace, and affine extension.

Bit vectors are Python integers, so one kernel serves any pattern length. A script is a list of
(op, length): 0 match, 1 mismatch, 2 more target, 3 more query.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, MORE_TARGET, MORE_QUERY = 0, 1, 2, 3


def _vectors(a: str, b: str, free_start: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Vertical differences after each letter of ``b`` and the last-row distances."""
    m = len(a)
    full = (1 << m) - 1
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    up, down, score, top = full, 0, m, 1 << (m - 1)
    cols, last = [], [m]
    for ch in b:
        eq = peq.get(ch, 0)
        v = eq | down
        h = ((((eq & up) + up) ^ up) | eq) & full
        more, less = (down | ~(h | up)) & full, up & h
        score += bool(more & top) - bool(less & top)
        more = ((more << 1) | (0 if free_start else 1)) & full
        less = (less << 1) & full
        up, down = (less | ~(v | more)) & full, more & v
        cols.append((up, down))
        last.append(score)
    return cols, last


def distance(a: str, b: str, limit: int | None = None) -> int:
    """Edit distance of two texts, -1 above ``limit``."""
    d = _vectors(a, b, False)[1][-1] if a else len(b)
    return -1 if limit is not None and d > limit else d


def script(query: str, target: str) -> list[tuple[int, int]]:
    """A shortest edit script from query to target."""
    cols, _ = _vectors(query, target, False) if query else ([], [])
    i, j, out = len(query), len(target), []
    while i and j:
        bit = 1 << (i - 1)
        if cols[j - 1][0] & bit:
            out.append(MORE_QUERY)
            i -= 1
        elif j > 1 and cols[j - 2][1] & bit:
            out.append(MORE_TARGET)
            j -= 1
        else:
            out.append(MATCH if query[i - 1] == target[j - 1] else MISMATCH)
            i, j = i - 1, j - 1
    out += [MORE_QUERY] * i + [MORE_TARGET] * j
    runs: list[tuple[int, int]] = []
    for op in reversed(out):
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + 1)
        else:
            runs.append((op, 1))
    return runs


def apply_script(query: str, target: str, runs: list[tuple[int, int]]) -> str:
    """The target rebuilt from the query and the letters that the script takes from the target."""
    out, i, j = [], 0, 0
    for op, n in runs:
        if op == MATCH:
            out.append(query[i : i + n])
        elif op in (MISMATCH, MORE_TARGET):
            out.append(target[j : j + n])
        i += n if op != MORE_TARGET else 0
        j += n if op != MORE_QUERY else 0
    return "".join(out)


def errors(runs: list[tuple[int, int]]) -> int:
    return sum(n for op, n in runs if op != MATCH)


def encode_script(runs: list[tuple[int, int]]) -> list[int]:
    """Cells of 2 bits op and 14 bits length; longer runs take several cells."""
    out = []
    for op, n in runs:
        while n > 0:
            k = min(n, (1 << 14) - 1)
            out.append((op << 14) | k)
            n -= k
    return out


def decode_script(cells: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for x in cells:
        op, n = x >> 14, x & ((1 << 14) - 1)
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + n)
        else:
            runs.append((op, n))
    return runs


def longest_exact(runs: list[tuple[int, int]]) -> tuple[int, int]:
    """(query start, length) of the longest match run, the first of equals."""
    best, i = (0, 0), 0
    for op, n in runs:
        if op == MATCH and n > best[1]:
            best = (i, n)
        i += n if op != MORE_TARGET else 0
    return best


def find(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the best place of a pattern in a text, ends free; the first end, then the latest start."""
    if not pattern:
        return 0, 0, 0
    last = _vectors(pattern, text, True)[1]
    d = min(last)
    end = last.index(d)
    back = _vectors(pattern[::-1], text[:end][::-1], False)[1]
    return d, end - back.index(d), end


def extend(a: str, b: str, most: int) -> tuple[int, int, int]:
    """(letters of a, letters of b, edits): the longest pair of prefixes within ``most`` edits.

    Extension from the other end is the same on reversed texts.
    """
    if not a or not b:
        return 0, 0, 0
    prev = np.arange(len(b) + 1)
    cols = np.arange(len(b) + 1)
    bb = np.frombuffer(b.encode("latin1", "replace"), np.uint8)
    best = (0, 0, 0)
    for i, ch in enumerate(a.encode("latin1", "replace"), 1):
        cur = prev + 1
        cur[1:] = np.minimum(cur[1:], prev[:-1] + (bb != ch))
        prev = np.minimum.accumulate(cur - cols) + cols
        ok = np.flatnonzero(prev <= most)
        if not len(ok):
            break
        j = int(ok[-1])
        if i + j > best[0] + best[1]:
            best = (i, j, int(prev[j]))
    return best


def affine(query: str, target: str, match: int = 2, mismatch: int = 4, gap_open: int = 4, gap_ext: int = 2, band: int = 500, zdrop: int = 400) -> tuple[int, int, int]:
    """(score, query end, target end) of the best extension from both starts with affine gaps.

    A gap of n letters costs gap_open + n * gap_ext. Rows end once the best of a row has fallen
    more than ``zdrop`` (and the gap cost of the drift) below the best so far.
    """
    if not query or not target:
        return 0, 0, 0
    t = np.frombuffer(target.encode("latin1", "replace"), np.uint8)
    n = len(t)
    j = np.arange(n + 1)
    low = -(10**9)
    h = np.where(j == 0, 0, -(gap_open + gap_ext * j)).astype(np.int64)
    e = np.full(n + 1, low, np.int64)
    best = (0, 0, 0)
    for i, ch in enumerate(query.encode("latin1", "replace"), 1):
        e = np.maximum(e, h - gap_open) - gap_ext
        diag = np.full(n + 1, low, np.int64)
        diag[1:] = h[:-1] + np.where(t == ch, match, -mismatch)
        g = np.maximum(diag, e)
        g[np.abs(j - i) > band] = low
        f = np.maximum.accumulate(np.concatenate([[low], g[:-1] + gap_ext * j[:-1]])) - gap_open - gap_ext * j
        h = np.maximum(g, f)
        h[np.abs(j - i) > band] = low
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), i, k)
        elif best[0] - h[k] > zdrop + gap_ext * abs((i - best[1]) - (k - best[2])):
            break
    return best

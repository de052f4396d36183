"""Coverage peaks of a count histogram (a table of at most 4,096 rows, handled on the driver)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Peaks:
    trough: int
    hom: int
    het: int


def find_peaks(hist: dict[int, int], start: int = 5, depth: int | None = None) -> Peaks:
    """Trough, homozygous and heterozygous peak; -1 where there is none.

    The trough is the last bin before the first rise, the main peak the highest bin behind it.
    The left candidate is the highest local maximum between them (a plateau counts; of equals the one nearest to the main peak), at least 5 % of the main peak
    and with a valley under 95 % of itself; the right candidate also lies within 2.5 times the
    main position. With a right peak it is homozygous and the main one heterozygous. A depth
    known otherwise picks the nearest of the three (the main one of equals); if that is half or less of it, the depth
    is taken as homozygous and the peak as heterozygous.
    """
    top = max(hist, default=0)
    h = [hist.get(i, 0) for i in range(top + 2)]
    i = max(start, 1)
    while i + 1 <= top and h[i + 1] <= h[i]:
        i += 1
    if i + 1 > top:
        return Peaks(-1, -1, -1)
    trough = i
    main = max(range(trough + 1, top + 1), key=lambda x: (h[x], -x))

    def local(lo: int, hi: int) -> list[int]:
        return [x for x in range(lo, hi + 1) if h[x] > 0 and h[x] >= h[x - 1] and h[x] >= h[x + 1]]

    def solid(x: int, a: int, b: int) -> bool:
        return h[x] >= 0.05 * h[main] and min(h[a : b + 1]) < 0.95 * h[x]

    left = max(local(trough + 1, main - 1), key=lambda x: (h[x], x), default=-1)
    if left >= 0 and not solid(left, left, main):
        left = -1
    right = max(local(main + 1, top), key=lambda x: (h[x], -x), default=-1)
    if right >= 0 and (right > 2.5 * main or not solid(right, main, right)):
        right = -1
    if depth:
        near = min((x for x in (main, left, right) if x >= 0), key=lambda x: abs(x - depth))
        if near < depth and depth - near >= 0.51 * near:
            return Peaks(trough, depth, near)
        return Peaks(trough, near, max((x for x in (left, main) if 0 <= x < near), default=-1))
    return Peaks(trough, right, main) if right >= 0 else Peaks(trough, main, left)

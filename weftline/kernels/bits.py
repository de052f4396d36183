"""Vectorised letter packing and 64-bit mixing over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the 64-bit finaliser of MurmurHash3
_I1, _I2 = np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64)), np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
_S = np.uint64(33)

#: Two-bit code of a letter; 4 for anything but A, C, G and T in either case.
CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    h = x.astype(np.uint64, copy=True)
    h ^= h >> _S
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """Inverse of ``mix``."""
    x = h.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _I2
    x ^= x >> _S
    x *= _I1
    x ^= x >> _S
    return x


def packed(code: np.ndarray, k: int) -> np.ndarray:
    """k-letter words starting at every position, k <= 32; the tail is padded with A."""
    out = np.zeros(len(code) + 64, np.uint64)
    out[: len(code)] = code
    have, n = {1: out}, 1
    while n * 2 <= k:
        nxt = out << np.uint64(2 * n)
        nxt[:-n] |= out[n:]
        out, n = nxt, n * 2
        have[n] = out
    acc, m = have[n], n
    while m < k:
        step = max(s for s in have if s <= k - m)
        nxt = acc << np.uint64(2 * step)
        nxt[:-m] |= have[step][m:]
        acc, m = nxt, m + step
    return acc


def packed_reverse(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse complement of the k-letter word starting at every position."""
    rc = packed((3 - np.minimum(code, 3))[::-1], k)[: len(code)]
    # the word that starts at i ends at i + k - 1, which is place n - i - k of the reversed text
    out = np.zeros(len(code), np.uint64)
    n = len(code) - k + 1
    if n > 0:
        out[:n] = rc[:n][::-1]
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of h[i:i+w] for every full window."""
    n = 1
    while n * 2 <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if w > n else h


def column_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = col.fill_null("").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def letter_runs(code: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid letters inside one record: (start, end, record), at least ``least`` long."""
    bad = np.flatnonzero(code == 4)
    cuts = np.unique(np.concatenate([off, bad, bad + 1]))
    lo, hi = cuts[:-1], cuts[1:]
    keep = (hi - lo >= least) & (code[np.minimum(lo, max(len(code) - 1, 0))] < 4) if len(code) else np.zeros(len(lo), bool)
    lo, hi = lo[keep], hi[keep]
    return lo, hi, np.searchsorted(off, lo, "right") - 1


#: Letters that a kernel works on at a time; with about ten 8-byte arrays a letter this bounds a worker's memory near 100 MB.
SLICE_LETTERS = 1 << 20


def text_slices(ids: pa.Array | None, texts: pa.Array, letters: int = SLICE_LETTERS):
    """(ids, bytes, offsets) of consecutive rows with about ``letters`` letters together; a longer text comes alone."""
    data, off = column_text(texts)
    rid = np.zeros(len(texts), np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + letters, "right")) - 1)
        yield rid[lo:hi], data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi

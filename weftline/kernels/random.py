"""splitmix64, the public generator of Steele, Lea and Flood, on arrays of seeds."""

from __future__ import annotations

import numpy as np

_GAMMA, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of the generator


def splitmix64(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(draws, next states)."""
    state = state.astype(np.uint64) + _GAMMA
    z = (state ^ (state >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31)), state


def first_doubles(seeds: np.ndarray) -> np.ndarray:
    """The first draw of each seed in [0, 1), from the upper 53 bits."""
    return (splitmix64(seeds.view(np.uint64) if seeds.dtype == np.int64 else seeds)[0] >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Stream:
    """One generator with draws as Python numbers."""

    def __init__(self, seed: int = 11):
        self.state = np.array([seed], np.uint64)

    def bits(self) -> int:
        z, self.state = splitmix64(self.state)
        return int(z[0])

    def uniform(self) -> float:
        return (self.bits() >> 11) * 2.0**-53

    def uniforms(self, n: int) -> np.ndarray:
        """The next n draws of ``uniform`` at once."""
        z, state = splitmix64(self.state + _GAMMA * np.arange(n, dtype=np.uint64))
        if n:
            self.state = state[-1:]
        return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def shuffle(self, n: int) -> np.ndarray:
        """A permutation of 0..n-1 (Fisher-Yates)."""
        out = np.arange(n)
        for i in range(n - 1, 0, -1):
            j = int(self.uniform() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out

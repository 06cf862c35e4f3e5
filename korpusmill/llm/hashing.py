"""64-bit hashes of byte strings inside Arrow buffers, computed for all of a batch at once."""

from __future__ import annotations

import numpy as np

#: An odd multiplier modulo 2**64: prefix sums of byte * BASE**i give any substring's polynomial hash.
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out[:n]


class Powers:
    """Tables of powers that grow when needed. Another seed has another base, and numbers of its own for the bytes, so its hashes collide elsewhere."""

    def __init__(self, seed: int = 0):
        self.base = BASE + 2 * seed
        self.inverse = pow(self.base, -1, 1 << 64)
        self.byte = np.arange(1, 257, dtype=np.uint64)
        if seed:
            self.byte = mix(self.byte * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up[:n], self.down[:n]


def prefix_sums(data: np.ndarray, tables: Powers) -> np.ndarray:
    """One more number than bytes; see substrings()."""
    up, _ = tables.upto(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables.byte[data] * up, out=out[1:])
    return out


def substrings(sums: np.ndarray, start: np.ndarray, end: np.ndarray, tables: Powers) -> np.ndarray:
    """Mixed hash of data[start:end] for each pair; equal strings have equal hashes wherever they stand."""
    _, down = tables.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])

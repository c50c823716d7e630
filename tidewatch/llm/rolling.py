"""Rolling polynomial hashes of bytes (modulo 2**64) and sliding minima, on numpy arrays."""

from __future__ import annotations

import numpy as np


def _inverse(q: int) -> int:
    return pow(q, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of polynomial hashes; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any bytes[i:j] from one cumulative sum: sum of value(byte) * Q**place, moved to place 0."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.q = int(rng.integers(1, 1 << 61)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            for name, q in (("up", self.q), ("down", _inverse(self.q))):
                steps = np.full(size, q, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """data: uint8; what span() and windows() need, one longer than data."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The hash of each bytes[i:i + k]."""
        n = len(sums) - k
        return mix((sums[k:] - sums[:n]) * self.down[:n])

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of bytes[start:end]."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each i; len(x) >= w."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m

"""Vectorised fingerprints of words and of byte ranges, for use inside tasks.

A range of bytes is hashed as a polynomial over random 64-bit byte values,
modulo 2**64; with sums over prefixes any range costs two look-ups. A final
mix spreads the bits. Two such hashes of other values and bases (``salt`` 0
and 1) make a name of 128 bits. Sums modulo 2**64 do not tell all strings of
more than a thousand bytes apart, so words of LONG bytes and more take a
cryptographic hash.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.RandomState(20240229)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_VALUES = [_RNG.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32) | _RNG.randint(0, 1 << 32, 256, dtype=np.uint64) for _ in _BASES]
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once where a text can be cut at blanks.
BLOCK = 1 << 20
LONG = 64

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(salt: int, up: bool, n: int) -> np.ndarray:
    """Powers of a base, or of its inverse."""
    known = _powers.get((salt, up), np.ones(1, np.uint64))
    if len(known) < n:
        factors = np.full(max(n, 2 * len(known), 1 << 12), _BASES[salt] if up else pow(_BASES[salt], -1, 1 << 64), np.uint64)
        factors[0] = 1
        known = _powers[salt, up] = np.multiply.accumulate(factors)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of ranges [start, end) of one byte string."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[salt][data] * _power(salt, True, n), out=self.sums[1:])
        self.down = _power(salt, False, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all ranges of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every blank-separated word, in order."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not IS_BLANK[data[end]]:  # cut between words only
            end += 1
        block = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.empty(len(block) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~IS_BLANK[block]
        edges = np.flatnonzero(np.diff(inside))
        start, stop = edges[::2], edges[1::2]
        found = Ranges(block).hashes(start, stop)
        for k in np.flatnonzero(stop - start >= LONG):
            found[k] = int.from_bytes(hashlib.blake2b(block[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
        out.append(found)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)

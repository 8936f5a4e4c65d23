"""Words, word hashes and k-gram hashes of UTF-8 text as numpy arrays, many texts at once.

All word classes used here are unions of ASCII ranges with everything from U+0080 on, so
they can be told from single bytes of UTF-8.
"""

from __future__ import annotations

import numpy as np

#: `[^\x20\x09-\x0D]+`
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C55, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, self.n * 2)
            self.up, self.down = (self._all(b, self.n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _all(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), [Powers(b) for b in WORD_BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = inside[1:] != inside[:-1]
    starts = np.flatnonzero(np.concatenate(([inside[0]], edge & inside[1:])))
    ends = np.flatnonzero(np.concatenate((edge & inside[:-1], [inside[-1]]))) + 1
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):  # two texts meet inside a run of word bytes
        starts = np.sort(np.concatenate((starts, cuts)))
        ends = np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = BYTE_POWERS.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k consecutive entries; those that cross texts are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = WORD_POWERS[which].get(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the entries from each start to each end; the length counts."""
    up, down = WORD_POWERS[which].get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

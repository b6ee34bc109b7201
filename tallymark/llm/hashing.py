"""64-bit hashes of byte ranges, words and word shingles, for whole texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers; arithmetic of ``mix`` is modulo 2 to the 64th.
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)
#: A prime, and the bases of two polynomials modulo it. Modulo a power of two, unequal ranges of equal hash can be
#: written down for any base; modulo a prime two ranges of n units agree for n - 1 of the bases at most.
PRIME = (1 << 31) - 1
BASES = (1_283_705_497, 795_028_841)
_P, _31 = U(PRIME), U(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def modulo(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    return x - x // _P * _P


class _Powers:
    """Powers of a number modulo the prime, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.all = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.all) < n:
            self.all = np.concatenate([self.all, modulo(self.all * U(pow(self.base, len(self.all), PRIME)))])
        return self.all[:n]


_UP = [_Powers(b) for b in BASES]
_DOWN = [_Powers(pow(b, -1, PRIME)) for b in BASES]


class Ranges:
    """Hashes of any range of ``data`` (bytes, or 64-bit hashes): equal ranges have equal hashes wherever they stand.

    Two polynomials modulo a prime of 31 bits; of 64-bit units one takes the low half and the other the high half.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        halves = [data + U(1)] * 2 if data.dtype == np.uint8 else [modulo(data & U(0xFFFFFFFF)), modulo(data >> U(32))]
        self.sums = []
        for half, up in zip(halves, _UP):
            sums = np.zeros(n + 1, U)
            np.cumsum(modulo(half * up.upto(n)), out=sums[1:])  # below two to the 31st each, so no text is too long
            self.sums.append(sums)
        self.down = [d.upto(n + 1) for d in _DOWN]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (modulo(modulo(s[end] - s[start]) * d[start]) for s, d in zip(self.sums, self.down))
        return mix(mix((a << _31) | b) + (end - start).astype(U))


#: Bytes that ``words`` looks at together, so that long texts need no long table of powers.
STRETCH = 1 << 20


def words(text: str) -> np.ndarray:
    """A hash for each run without ASCII white space."""
    return words_in(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0]


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of bytes without ASCII white space, and where it starts."""
    padded = np.zeros(len(data) + 2, bool)
    inside = padded[1:-1]
    np.logical_and(data != 32, data - np.uint8(9) > 4, out=inside)
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    start, end = edge[::2], edge[1::2]
    found, i = [np.zeros(0, U)], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, "right")))
        a, b = start[i], end[j - 1]
        units = (data[a:b].astype(U) + U(1)) * inside[a:b]
        at, both = start[i:j] - a, []
        for up, down in zip(_UP, _DOWN):
            each = units * up.upto(b - a)
            # Nine bits more than the prime's: sums of fewer than 2 ** 24 bytes fit without a remainder for each.
            total = np.add.reduceat(each if b - a < 1 << 24 else modulo(each), at)
            both.append(modulo(modulo(total) * down.upto(b - a)[at]))
        found.append(mix(mix((both[0] << _31) | both[1]) + (end[i:j] - start[i:j]).astype(U)))
        i = j
    return np.concatenate(found), start


def shingles(text: str, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; a shorter text that has words is one shingle."""
    w = words(text)
    if not len(w):
        return w
    if len(w) < size:
        return mix((w * _STEPS[: len(w)]).sum(dtype=U, keepdims=True) + np.array([len(w)], U))
    n = len(w) - size + 1
    total = np.zeros(n, U)
    for i in range(size):
        total += w[i : i + n] * _STEPS[i % len(_STEPS)] + U(i)
        total ^= total >> U(29)
    return mix(total)

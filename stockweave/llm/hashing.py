"""Hashes of words and of runs of words, in arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# One random number for each byte and each of two hashes, made by rule.
LETTERS = mix(np.arange(1, 513, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(2, 256)
BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class Roller:
    """Hash of any stretch of a row of numbers, from sums of the row times powers."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(0, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(_inverse(self.base), n)

    def sums(self, row: np.ndarray) -> np.ndarray:
        self._grow(len(row) + 1)
        out = np.zeros(len(row) + 1, U)
        np.cumsum(row * self.up[: len(row)], out=out[1:], dtype=U)
        return out

    def stretches(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


ROLLERS = tuple(Roller(b) for b in BASES)


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    ink = np.zeros(len(raw) + 2, np.int8)
    ink[1:-1] = ~BLANK[raw]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_places(raw)
    roller = ROLLERS[which]
    return roller.stretches(roller.sums(LETTERS[which][raw]), start, end)


def runs(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` numbers."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    roller = ROLLERS[which]
    at = np.arange(n)
    return roller.stretches(roller.sums(hashes), at, at + size)

"""Words of whole texts as numpy arrays: word borders, word hashes and Rabin-Karp hashes of word windows.

All hashes are polynomials modulo 2**64 over an odd base, taken for every
window at once from prefix sums: with ``P[i] = sum(x[j] * b**j for j < i)`` the
window ``[i, k)`` has the hash ``(P[k] - P[i]) * b**-i``. Words are hashed from
their bytes, then mixed, and windows from their words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd bases of the two polynomials.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Powers of a base that are kept: more are made from these, and only for as long as they are used.
KEPT = 1 << 14

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    if base not in _powers:
        own = np.empty(KEPT, _U)
        own[0], done = 1, 1
        while done < KEPT:
            own[done : 2 * done] = own[:done] * _U(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = own
    low = _powers[base]
    if n <= KEPT:
        return low[:n]
    blocks, step = -(-n // KEPT), pow(base, KEPT, 1 << 64)
    high = np.empty(blocks, _U)
    x = 1
    for i in range(blocks):
        high[i], x = x, x * step & 0xFFFFFFFFFFFFFFFF
    return (high[:, None] * low[None, :]).ravel()[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a text given as bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p = prefix(data.astype(_U) + _U(1), BYTE_BASE)
    h = (p[ends] - p[starts]) * powers(inverse(BYTE_BASE), len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of ``n`` words (none if there are fewer)."""
    if len(words) < n:
        return np.empty(0, _U)
    p = prefix(words, WORD_BASE)
    return mix((p[n:] - p[:-n]) * powers(inverse(WORD_BASE), len(words) - n + 1))


def hashed(text: bytes) -> np.ndarray:
    """Hashes of a text's words."""
    data = np.frombuffer(text, np.uint8)
    return word_hashes(data, *borders(data))

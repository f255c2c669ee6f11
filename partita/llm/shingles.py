"""Word shingles of whole texts as sorted sets of 64-bit codes."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

_byte = np.arange(256, dtype=np.uint64)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + np.uint64(32), _byte) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            t = np.full(max(n, 1 << 16), b, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def word_codes(text: str) -> np.ndarray:
    """A code of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased: a polynomial of its bytes, from running sums."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * power[: len(raw)], dtype=np.uint64)])
    return mix64((sums[end] - sums[start]) * inverse[start])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct codes of a text's k-word shingles; with fewer words one code of them all; none without words."""
    w = word_codes(text or "")
    n = len(w)
    if not n:
        return w
    size = min(k, n)
    code = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        code = mix64(code * _MULT + w[j : n - size + 1 + j])
    return np.unique(code)


def order_codes(codes: np.ndarray, seed: int) -> np.ndarray:
    """Where codes stand in the seed's pseudo-random order."""
    return mix64(codes ^ np.uint64((seed * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))

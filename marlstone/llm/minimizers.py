"""Minimizers of byte strings: each window of a given length has one, and equal windows have equal ones."""

from __future__ import annotations

import numpy as np

from marlstone.llm.near_dedup import mix

#: Bytes of a minimizer's gram, a power of two.
GRAM = 32

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes that are worked on at once.
_SLICE = 1 << 16


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    h, size, power = _TABLE[data], 1, 0x9E3779B97F4A7C15 | 1
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = size * 2, power * power % (1 << 64)
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def minimizers(data: bytes, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, last): the chosen gram's hash for each run of neighbouring windows that choose the same place.

    ``first`` to ``last`` are the windows' starts. The gram with the smallest hash is chosen, of
    equal ones the leftmost, so the choice, and its place in the window, depend on the window's
    bytes alone. Text shorter than a window has none.
    """
    n = len(data) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    raw = np.frombuffer(data, np.uint8)
    hashes, firsts, lasts = [], [], []
    for low in range(0, n, _SLICE):
        part = raw[low : min(low + _SLICE, n) + window - 1]
        h = gram_hashes(part, gram)
        best = (_sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(best, prepend=-1))
        hashes.append(h[best[first]])
        firsts.append(first + low)
        lasts.append(np.append(first[1:], len(best)) - 1 + low)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)

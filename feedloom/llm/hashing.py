"""Words, word windows and their 64-bit hashes for many texts at once, over the UTF-8 bytes in an Arrow buffer.

A word is a run of bytes outside space and \\x09-\\x0D. Hashes depend on the words alone, so they agree between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(29).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Bytes that are hashed at a time, cut between words; the tables of powers that a worker keeps are as long.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    made = np.cumprod(up), np.cumprod(down)
    if n <= CHUNK:
        _powers = made
    return made


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """``start``/``end``: byte range of each word. ``first[i]:first[i + 1]``: the words of text i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of runs of about ``CHUNK`` bytes, each at a space or the end of a text; a longer word stays whole."""
    n, cuts = len(data), []
    at = CHUNK
    while at < n:
        own = int(offsets[min(np.searchsorted(offsets, at), len(offsets) - 1)])
        stop, step = at, 1 << 12
        while stop < own and not _SPACE[data[stop : stop + step]].any():
            stop += step
        found = np.flatnonzero(_SPACE[data[stop : stop + step]])
        at = min(stop + int(found[0]) if stop < own and len(found) else own, own)
        cuts.append(at)
        at += CHUNK
    return [*(c for c in cuts if c < n), n]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    made, at = [], 0
    for stop in _cuts(data, offsets):
        edge = offsets[(offsets > at) & (offsets < stop)] - at
        start, end, value = _words_of(data[at:stop], edge)
        made.append((start + at, end + at, value))
        at = stop
    start, end, value = made[0] if len(made) == 1 else (np.concatenate(c) for c in zip(*made))
    return Words(start, end, np.searchsorted(start, offsets), value)


def _words_of(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word; words end with their text, at the places ``edge``."""
    n = len(data)
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), np.zeros(n + 1, dtype=bool)
    opens[1:] &= ~inside[:-1]
    closes[1:] = inside
    closes[1:n] &= ~inside[1:]
    opens[edge] |= inside[edge]
    closes[edge] |= inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    value = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _BASE
    return start, end, mix(value)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; windows that cross texts are for the caller to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for place in range(width):
        total += hashes[place : place + n] * _PLACE[place]
    return mix(total + np.uint64(width * int(_BASE) % (1 << 64)))

"""Words and word windows of a batch of texts, as NumPy arrays.

All texts of a batch lie in one byte buffer. Words are runs of bytes that are
no separators; a word's hash is a polynomial over its bytes (modulo 2^64, from
prefix sums), a window's hash one over its words' hashes; both are mixed.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Separators of plain words: space and the controls 9 to 13.
WHITE = bytes([*range(0x09, 0x0E), 0x20])
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)


_powers: dict[str, np.ndarray] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions below ``length``."""
    if not _powers or len(_powers["up"]) < length:
        size = 1 << int(length).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, factor in (("up", BASE), ("down", inverse)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def spans(data: np.ndarray, borders: np.ndarray, separators: bytes = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word; the first word of every text (and the end)."""
    lookup = np.ones(256, bool)
    lookup[list(separators)] = False
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = lookup[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    if len(data):
        first = borders[:-1][np.diff(borders) > 0]
        starts[first] = inside[1 + first]
        ends[first[1:] - 1] = inside[first[1:]]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, borders)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """64-bit hash of every word; about ``step`` bytes are worked on at a time."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + step, "right")))
        piece = data[begin : int(ends[high - 1])]
        up, down = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_byte_values()[piece] * up[: len(piece)], out=total[1:])
        first, last = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = (total[last] - total[first]) * down[first]
        low = high
    return mix(out)


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` values, whatever text they are in."""
    count = max(0, len(values) - length + 1)
    total = np.zeros(count, np.uint64)
    for i in range(length):
        total *= STEP
        total += values[i : i + count]
    return mix(total)


def window_places(word_borders: np.ndarray, length: int) -> np.ndarray:
    """First words of all windows that lie within one text."""
    total = int(word_borders[-1])
    # A window may not begin in the last length - 1 words of its text.
    ok = np.ones(total, bool)
    for back in range(1, length):
        at = word_borders[1:] - back
        ok[at[at >= word_borders[:-1]]] = False
    return np.flatnonzero(ok)


def lowest(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of every ``width`` neighbours and the place of the leftmost one."""
    least, place = values.copy(), np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        right, right_place = least[step:], place[step:]
        take = right < least[:-step]
        least = np.where(take, right, least[:-step])
        place = np.where(take, right_place, place[:-step])
        have += step
    return least, place

"""Words of many texts at once, as 64-bit hashes, straight from their UTF-8 bytes.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters; A-Z are lower-cased. All
non-ASCII characters are word characters, so the bytes of a character never need to be decoded.
"""

from __future__ import annotations

import numpy as np

#: Byte to lower-cased word byte; 0 where no word continues.
FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        FOLD[_c] = _c
    elif 0x41 <= _c <= 0x5A:
        FOLD[_c] = _c + 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[at] = np.multiply.accumulate(grown)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLD, ends_too: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of each word in reading order, and per text the number of words before it (one entry more than texts); with ``ends_too`` also where each word begins and ends.

    ``table`` gives each byte's part in a word's hash; a word is a run of bytes whose part isn't 0. Different words may have one hash: who needs to be sure compares them.
    """
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *((np.zeros(0, np.int64), np.zeros(0, np.int64)) if ends_too else ()))
    folded = table[data]
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    starts[firsts] = inside[firsts]
    begin = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:]
    lasts = lasts[lasts > 0] - 1
    ends[lasts] = inside[lasts]
    end = np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(folded * power[:n], out=total[1:])
    hashes = (total[end] - total[begin]) * inverse[begin]
    hashes += (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix(hashes), np.searchsorted(begin, offsets), *((begin, end) if ends_too else ()))


def shingles(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, and per text the number of runs before it; a shorter text that has words is one run."""
    count = np.diff(before)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(count)), runs)
    at = before[row] + (np.arange(start[-1]) - start[row])
    stop = before[row + 1]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    short = at + size > stop
    for k in range(size):
        part = padded[at + k]
        if short.any():
            part[short & (at + k >= stop)] = np.uint64(k + 1)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out, start

"""A worker's bounded memory of units of text (words, pieces) and what was found for each, used by whole blocks of text at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quillmark.llm.words import _power_tables, mix


def unit_keys(line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``line[begin:end]``."""
    power, inverse = _power_tables(len(line))
    total = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * power[: len(line)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_units(a: np.ndarray, a_begin: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether each ``a[begin:begin + size]`` equals its ``b[begin:begin + size]``; no unit is empty."""
    same = a_size == b_size
    ask = np.flatnonzero(same & (a_begin != b_begin)) if a is b else np.flatnonzero(same)
    if len(ask):
        size = a_size[ask]
        step = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(step[-1]) - np.repeat(step[:-1], size)
        differ = a[np.repeat(a_begin[ask], size) + inside] != b[np.repeat(b_begin[ask], size) + inside]
        same[ask] = np.add.reduceat(differ, step[:-1]) == 0
    return same


class Remembered:
    """Units with a list of numbers each. Hashes say where to look; units are then compared symbol by symbol."""

    def __init__(self, most: int, symbol: str, number: str):
        self.most, self.symbol, self.number = most, symbol, number
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.at, self.count = (np.zeros(0, np.int64) for _ in range(4))
        self.line, self.values = np.zeros(0, self.symbol), np.zeros(0, self.number)

    def _add(self, line: np.ndarray, begin: np.ndarray, size: np.ndarray, values: list) -> np.ndarray:
        """Slots of new units."""
        step = np.concatenate([[0], np.cumsum(size)])
        flat = line[np.repeat(begin - step[:-1], size) + np.arange(step[-1])]
        count = np.array([len(v) for v in values], np.int64)
        slots = len(self.begin) + np.arange(len(begin))
        self.begin, self.size = np.concatenate([self.begin, len(self.line) + step[:-1]]), np.concatenate([self.size, size])
        self.at, self.count = np.concatenate([self.at, len(self.values) + np.cumsum(count) - count]), np.concatenate([self.count, count])
        self.line = np.concatenate([self.line, flat.astype(self.symbol)])
        self.values = np.concatenate([self.values, *(np.asarray(v, self.number) for v in values)]) if len(values) < 64 else np.concatenate([self.values, np.fromiter((x for v in values for x in v), self.number, int(count.sum()))])
        return slots

    def slots_of(self, key: np.ndarray, line: np.ndarray, begin: np.ndarray, end: np.ndarray, make: Callable[[list[int]], list]) -> np.ndarray:
        """The slot of each unit ``line[begin:end]``; ``make`` gives the numbers of units, named by their places, that aren't known."""
        if len(self.keys) > self.most:
            self.clear()
        size = end - begin
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        slot = np.full(len(unique), -1, np.int64)
        taken = np.zeros(len(unique), bool)  # hashes that the table has, if for another unit
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            taken = self.keys[at] == unique
            ask, old = np.flatnonzero(taken), self.slots[at[taken]]
            good = same_units(line, begin[first[ask]], size[first[ask]], self.line, self.begin[old], self.size[old])
            slot[ask[good]] = old[good]
        new = np.flatnonzero(slot < 0)
        if len(new):
            own = first[new]
            slot[new] = self._add(line, begin[own], size[own], make(own.tolist()))
            fresh = new[~taken[new]]
            where = np.searchsorted(self.keys, unique[fresh])
            self.keys, self.slots = np.insert(self.keys, where, unique[fresh]), np.insert(self.slots, where, slot[fresh])
        out = slot[back]
        other = np.flatnonzero(~same_units(line, begin, size, line, begin[first[back]], size[first[back]]))
        if len(other):  # different units with one hash
            out[other] = self._add(line, begin[other], size[other], make(other.tolist()))
        return out

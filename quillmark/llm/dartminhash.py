"""DartMinHash signatures of many weighted sets at once.

Every element owns a fixed Poisson process of darts on (weight, rank), cut into weight regions (0, 1],
(1, 2], (2, 4] and so on; a hash of the element, the region and the dart's number gives the gap to its rank,
its weight inside the region, its coordinate and its identity. A set is hit by the darts below its
weights, and keeps for each of ``k`` coordinates the dart of the lowest rank. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity. Ranks are thrown only up to a limit at
which k ln k + 2 k darts are expected in a set, however many elements it has; a set with a coordinate left
empty is thrown again up to twice the limit.
"""

from __future__ import annotations

import numpy as np

from quillmark.llm.words import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, start: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """One row of ``k`` 64-bit values for each set ``elements[start[i]:start[i + 1]]``; an empty set has all ones."""
    sets = len(start) - 1
    out = np.full(sets * k, _EMPTY, np.uint64)
    row = np.repeat(np.arange(sets), np.diff(start))
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    mass = np.bincount(row, weights, sets)
    limit = np.divide(k * np.log(k) + 2 * k, mass, out=np.zeros(sets), where=mass > 0)
    open_sets = mass > 0
    while open_sets.any():
        chosen = np.flatnonzero(open_sets[row] & (weights > 0))
        _throw(elements[chosen], row[chosen], weights[chosen], limit, k, out)
        left = (out.reshape(sets, k) == _EMPTY).any(axis=1)
        open_sets &= left
        limit = limit * 2
    return out.reshape(sets, k)


def _throw(element: np.ndarray, row: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int, out: np.ndarray) -> None:
    """Keeps in ``out`` the earliest darts up to each set's rank limit."""
    region = 0
    while len(element):
        low, high = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0**region)
        seed = mix(element + np.uint64((region * 0xA0761D6478BD642F) % (1 << 64)))
        _region(seed, row, weight, limit, k, out, low, high)
        above = weight > high
        element, row, weight = element[above], row[above], weight[above]
        region += 1


def _region(seed, row, weight, limit, k, out, low, high) -> None:
    most, rank, dart = limit[row], np.zeros(len(seed)), 0
    partial = bool((weight < high).any())
    width = high - low
    while len(seed):
        dart += 1
        h = mix(seed + np.uint64((dart * 0x9E3779B97F4A7C15) % (1 << 64)))
        rank -= np.log(((h >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / width
        live = rank < most
        if not live.all():
            seed, row, rank, most, h = seed[live], row[live], rank[live], most[live], h[live]
            if partial:
                weight = weight[live]
            if not len(seed):
                return
        identity = h * np.uint64(0xD1342543DE82EF95)
        value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (identity >> np.uint64(32))
        slot = row * k + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        if partial:
            depth = low + (mix(identity) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width
            inside = depth <= weight
            np.minimum.at(out, slot[inside], value[inside])
        else:
            np.minimum.at(out, slot, value)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` coordinates; the band's number is part of the key."""
    sets, k = signature.shape
    count = k // rows
    parts = signature[:, : count * rows].reshape(sets, count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (sets, count)).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)

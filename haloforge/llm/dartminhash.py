"""DartMinHash (Christiani, 2020): fast sparse weighted minwise signatures.

Every element owns an endless region: weight on one side, rank on the other.  Darts fall into it at a rate of one a
unit of area, at places fixed by hashes, the same for all sets.  A set sees the darts below its element's weight.
Each dart belongs to one of k coordinates; a coordinate's value is the seen dart of least rank.  Two sets agree in a
coordinate with a chance equal to their weighted Jaccard similarity.  A set of total weight W needs only the darts
of rank below (k ln k + 4 k) / W or so, about as many for a large set as for a small one.

A region is cut by weight into strips [0, base), [base, 2 base), [2 base, 4 base) and so on; in each, darts come by
rank with exponential gaps.
"""

from __future__ import annotations

import numpy as np

from haloforge.llm.words import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1.0 / (1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def _strips(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, base: float) -> tuple[np.ndarray, ...]:
    """For each element and strip it reaches: seed, low end and width of the strip, weight, owner."""
    top = np.maximum(np.ceil(np.log2(np.maximum(weight / base, 1e-300))), 0).astype(np.int64) + 1
    strip = np.arange(top.sum()) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(strip == 0, 0.0, base * 2.0 ** (strip - 1))
    width = np.where(strip == 0, base, low)
    seed = mix(np.repeat(element, top) + strip.astype(np.uint64) * _GOLD)
    return seed, low, width, np.repeat(weight, top), np.repeat(owner, top)


def _throw(seed, low, width, weight, owner, limit, k, block):
    """The darts of rank under ``limit`` (one for each strip) that are seen: owner, coordinate, rank, value."""
    parts = []
    rank = np.zeros(len(seed))
    first = 0
    while len(seed):
        number = np.arange(first, first + block, dtype=np.uint64)
        dart = mix(seed[:, None] + (number * _GOLD)[None, :])
        ranks = rank[:, None] + np.cumsum(-np.log(_uniform(dart)), axis=1) / width[:, None]
        other = mix(dart + np.uint64(1))
        seen = ranks <= limit[:, None]
        if len(low) and (weight < low + width).any():
            seen &= low[:, None] + _uniform(other) * width[:, None] <= weight[:, None]
        row, column = np.nonzero(seen)
        value = mix(other[row, column])
        parts.append((owner[row], (value % np.uint64(k)).astype(np.int64), ranks[row, column], value))
        rank, more = ranks[:, -1], ranks[:, -1] <= limit
        seed, low, width, weight, owner, limit, rank = (x[more] for x in (seed, low, width, weight, owner, limit, rank))
        first += block
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, d) for d in (np.int64, np.int64, np.float64, np.uint64)]


def signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None, k: int, base: float = 1.0) -> np.ndarray:
    """uint64 [sets, k].  elements: each set's distinct 64-bit hashes; weights: their weights over 0, all 1 if None.
    An empty set's row is 0."""
    sizes = np.fromiter(map(len, elements), dtype=np.int64, count=len(elements))
    out = np.zeros((len(elements), k), dtype=np.uint64)
    if not sizes.sum():
        return out
    element, owner = np.concatenate(elements), np.repeat(np.arange(len(elements)), sizes)
    weight = np.ones(len(element)) if weights is None else np.concatenate(weights).astype(np.float64)
    total = np.bincount(owner, weight, minlength=len(elements))
    strips = _strips(element, weight, owner, base)
    reach = np.where(total > 0, k * (np.log(k) + 4.0) / np.maximum(total, 1e-300), 0.0)
    left = total > 0
    while left.any():
        # Sets that need as many darts a strip, up to a factor of two, are thrown together.
        each = np.floor(np.log2(np.maximum(reach * base, 0.5))).astype(np.int64)
        for level in np.unique(each[left]):
            mine = (left & (each == level))[strips[4]]
            seed, low, width, w, own = (x[mine] for x in strips)
            who, coordinate, rank, value = _throw(seed, low, width, w, own, reach[own], k, int(min(2.0 ** (level + 1) + 2, 256)))
            order = np.argsort(-rank, kind="stable")  # where places repeat, the last value stays
            out[who[order], coordinate[order]] = value[order]
        left &= (out == 0).any(axis=1)
        out[left] = 0
        reach[left] *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each ``rows`` coordinates, the band's number mixed in; int64 [sets, k / rows]."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    total = np.zeros((n, k // rows), dtype=np.uint64) + (np.arange(k // rows, dtype=np.uint64) + np.uint64(1)) * _GOLD
    for j in range(rows):
        total = mix(total + parts[:, :, j])
    return total.view(np.int64)

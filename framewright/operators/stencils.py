"""Neighbourhoods of whole frames: every function takes an array (h, w) and returns one."""

from __future__ import annotations

import numpy as np

from framewright.operators.trace import ENTRIES, around

Offset = tuple[int, int]


def shifted(a: np.ndarray, dy: int, dx: int, border: str, outside: float = 0) -> np.ndarray:
    """What lies at the offset of each cell; ``border`` is 'edge', 'reflect' (mirrored without the edge) or 'constant'."""
    r = max(abs(dy), abs(dx))
    more = {"constant_values": outside} if border == "constant" else {}
    wide = np.pad(a, r, mode=border, **more)
    return wide[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]]


def weighted(a: np.ndarray, weights: list[tuple[int, int, float]], border: str) -> np.ndarray:
    return sum(w * shifted(a, dy, dx, border) for dy, dx, w in weights)


def most_frequent(groups: np.ndarray, offsets: list[Offset]) -> np.ndarray:
    """The most frequent group of each window, the edge repeated; the own group wins a tie, then the smallest."""
    near = [shifted(groups, dy, dx, "edge") for dy, dx in offsets]
    best, votes = groups.copy(), sum(n == groups for n in near)
    for g in np.unique(groups):  # upwards, so that a smaller one stays on a tie
        n = sum(v == g for v in near)
        better = (n > votes) & (groups != g)
        best, votes = np.where(better, g, best), np.where(better, n, votes)
    return best


def all_of(mask: np.ndarray, offsets: list[Offset]) -> np.ndarray:
    """Cells whose whole window lies in the mask; outside isn't in it."""
    return np.logical_and.reduce([shifted(mask, dy, dx, "constant") for dy, dx in offsets])


def any_of(mask: np.ndarray, offsets: list[Offset]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, dy, dx, "constant") for dy, dx in offsets])


def entries(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the circle around each cell enters the mask, and whether that makes a mask cell a junction."""
    ring = around(mask)
    n = (~ring & np.roll(ring, -1, axis=0)).sum(0)
    return n, mask & (n >= ENTRIES)

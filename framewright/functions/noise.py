"""Deterministic value noise from 64-bit integer hashes, with numpy's wrapping arithmetic.

The same values on every machine and in every partitioning: a value depends on the seed and the
lattice point alone.
"""

from __future__ import annotations

import numpy as np

# The results must be equal bit by bit, so these must be too.
GOLDEN = 0x9E3779B97F4A7C15
SALT = 0x2545F4914F6CDD1D
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)

_MASK = (1 << 64) - 1


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit word: shift-xor rounds, with a multiplication between them."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in zip(SHIFTS, (*MULTIPLIERS, 1), strict=True):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def seed(*parts: int) -> int:
    """A seed from integers in order."""
    h = np.uint64(SALT)
    for part in parts:
        h = scramble(h ^ np.uint64((part & _MASK) * GOLDEN & _MASK))[()]
    return int(h)


def lattice(key: int, *axes: np.ndarray) -> np.ndarray:
    """Uniform values in [-1, 1) at integer lattice points of two or three dimensions."""
    factors = (GOLDEN, *MULTIPLIERS)
    h = np.uint64(key)
    with np.errstate(over="ignore"):
        for i, (axis, factor) in enumerate(zip(axes, factors, strict=False)):
            word = np.asarray(axis, np.int64).astype(np.uint64) * np.uint64(factor)
            h = scramble(word + h if i == 0 else h ^ word)
    return (h >> np.uint64(11)).astype(np.float64) * (2.0 / (1 << 53)) - 1.0


def fade(t: np.ndarray) -> np.ndarray:
    """Quintic step with flat ends."""
    return t**3 * (10 + t * (6 * t - 15))


def field(key: int, x: np.ndarray, y: np.ndarray, *slab: int) -> np.ndarray:
    """Value noise at (x, y) in cells: lattice values blended along either axis; ``slab`` picks a slice of a 3-D field."""
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    u, v = fade(x - x0), fade(y - y0)
    rest = [np.full(x0.shape, z, np.int64) for z in slab]
    row = [lattice(key, x0, y0 + d, *rest) * (1 - u) + lattice(key, x0 + 1, y0 + d, *rest) * u for d in (0, 1)]
    return row[0] * (1 - v) + row[1] * v


def moving_field(key: int, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Noise that changes over time: two slabs mixed at equal power, clamped to [-1, 1]; a whole t is its slab."""
    z = int(np.floor(t))
    part = t - z
    if not part:
        return field(key, x, y, z)
    turn = part * np.pi / 2
    return np.clip(field(key, x, y, z) * np.cos(turn) + field(key, x, y, z + 1) * np.sin(turn), -1, 1)

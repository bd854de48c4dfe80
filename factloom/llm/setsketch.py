"""SetSketch registers: mergeable, locality-sensitive summaries of sets."""

from __future__ import annotations

import numpy as np

#: Registers a sketch, and the rows of a band of registers.
REGISTERS, BAND_ROWS = 216, 6
BANDS = REGISTERS // BAND_ROWS
#: Base of the exponential spacing, rate of the exponential values, largest register.
BASE, RATE, LARGEST = 1.02, 20.0, 65_535

_rng = np.random.default_rng(20_241)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_MULTIPLIERS = _rng.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each register the least of the elements' 32-bit hash values."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), 256):
        values = (short[at : at + 256, None] ^ _XOR) * _ODD
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(low, values.min(axis=0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Truncate exponentially distributed minima on an exponential scale.

    The least of exponential values is the exponential value of the least uniform one, so the
    logarithm is taken once a register, not once an element.
    """
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each sketch (one row a sketch); a key also tells its band."""
    from .hashing import mix

    bands = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    return mix((bands * _BAND_MULTIPLIERS).sum(axis=2, dtype=np.uint64) + _BAND_SEEDS)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches whose set sizes are known.

    A register is larger in a, larger in b or equal, with probabilities that depend only on the two
    sizes and the similarity; the likelihood of the three counts is maximised over a grid.
    """
    larger, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]
    chance = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    over, under = chance(u - v * grid), chance(v - u * grid)
    likelihood = larger * np.log(over) + smaller * np.log(under) + equal * np.log(np.clip(1 - over - under, 1e-12, 1))
    best = likelihood.argmax(axis=1)
    return grid[np.arange(len(best)), best]

"""Random numbers that depend on ``(seed, id)`` alone, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

# Increment and multipliers of the SplitMix64 generator (Steele, Lea, Flood 2014).
GOLDEN = 0x9E3779B97F4A7C15
FIRST = 0xBF58476D1CE4E5B9
SECOND = 0x94D049BB133111EB


def scramble(x: np.ndarray) -> np.ndarray:
    """SplitMix64 output step on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, ids: np.ndarray, count: int, first: int = 0) -> np.ndarray:
    """``count`` draws in (0, 1) for each id, from number ``first`` of its stream on."""
    with np.errstate(over="ignore"):
        start = scramble(np.array([seed], dtype=np.int64).view(np.uint64) + np.uint64(GOLDEN))
        key = scramble(start ^ (ids.astype(np.int64).view(np.uint64) * np.uint64(GOLDEN)))
        at = np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        bits = scramble(key[:, None] + at[None, :])
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def normals(seed: int, ids: np.ndarray, count: int) -> np.ndarray:
    """``count`` standard normal draws for each id (Box and Muller 1958)."""
    half = (count + 1) // 2
    u = uniforms(seed, ids, 2 * half)
    radius, angle = np.sqrt(-2.0 * np.log(u[:, :half])), 2.0 * np.pi * u[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :count]


def step_normals(seed: int, ids: np.ndarray, first: int, steps: int, width: int) -> np.ndarray:
    """Standard normal draws ``(ids, steps, width)`` of the steps from ``first`` on. A step's draws
    depend on ``(seed, id, step)`` alone, so a stream can be drawn in pieces of any length."""
    half = (width + 1) // 2
    u = uniforms(seed, ids, steps * 2 * half, first * 2 * half).reshape(len(ids), steps, 2 * half)
    radius, angle = np.sqrt(-2.0 * np.log(u[:, :, :half])), 2.0 * np.pi * u[:, :, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=2)[:, :, :width]

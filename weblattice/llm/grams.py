"""Hashed character n-grams, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weblattice.llm.arrow import code_points

#: Odd multipliers for the characters of an n-gram, by place.
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, each between two blanks, and the ends of the texts."""
    return code_points([f" {(t or '').lower()} " for t in texts])


def hashed(points: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket of the n-gram at every place, and the index of its text; none crosses two texts."""
    owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    shift = np.uint32(32 - bits)
    total = np.zeros(len(points), np.uint32)
    for n in range(1, max(sizes) + 1):
        count = len(points) - n + 1
        if count <= 0:
            return
        total = total[:count] + points[n - 1 :] * _STEPS[n - 1]
        if n in sizes:
            whole = owner[:count] == owner[n - 1 :]
            value = total + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            value = (value ^ (value >> np.uint32(12))) * np.uint32(0x297A2D39)
            yield (value >> shift)[whole], owner[:count][whole]

"""Seeded draws that do not depend on partitioning.

A stream is named by a text; its md5 gives two 32-bit bases, and draw k mixes
``base + k * STEP`` with an integer hash. The value is uniform on 62 bits, so
``% n`` is as good as unbiased. Distinct draws are the first n different values
of the stream, an exact uniform n-subset.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

# Fixed values of the integer hash (public 32-bit mixers and the golden ratio).
STEP = 0x9E3779B1
MULTIPLIERS = (0x2C1B3C6D, 0x297A2D39)
SHIFTS = (15, 12, 15)
MASK = 0xFFFFFFFF


def stream_bases(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    digests = [hashlib.md5(n.encode()).hexdigest() for n in names]
    first = np.array([int(d[:8], 16) for d in digests], dtype=np.uint64)
    second = np.array([int(d[8:16], 16) for d in digests], dtype=np.uint64)
    return first, second


def mix(x: np.ndarray) -> np.ndarray:
    mask = np.uint64(MASK)
    x = x & mask
    x = x ^ (x >> np.uint64(SHIFTS[0]))
    x = (x * np.uint64(MULTIPLIERS[0])) & mask
    x = x ^ (x >> np.uint64(SHIFTS[1]))
    x = (x * np.uint64(MULTIPLIERS[1])) & mask
    return x ^ (x >> np.uint64(SHIFTS[2]))


def draw(bases: tuple[np.ndarray, np.ndarray], count: int, size: int) -> np.ndarray:
    """(streams, count) values in [0, size)."""
    k = np.arange(count, dtype=np.uint64)[None, :] * np.uint64(STEP)
    one = np.uint64(1)
    high = mix(bases[0][:, None] + k) >> one
    low = mix(bases[1][:, None] + k) >> one
    return (((high << np.uint64(31)) | low) % np.uint64(size)).astype(np.int64)


def distinct_draws(
    bases: tuple[np.ndarray, np.ndarray], n: int, size: int
) -> np.ndarray:
    """(streams, n) distinct values in [0, size), sorted within a stream."""
    if n > size:
        raise ValueError(f"cannot draw {n} of {size}")
    streams = len(bases[0])
    if n == size:
        return np.tile(np.arange(size, dtype=np.int64), (streams, 1))
    expected = size * math.log(size / (size - n))
    count = int(expected + 4 * math.sqrt(expected) + 16)
    out = np.empty((streams, n), dtype=np.int64)
    todo = np.arange(streams)
    while len(todo):
        values = draw((bases[0][todo], bases[1][todo]), count, size)
        order = np.argsort(values, axis=1, kind="stable")
        ranked = np.take_along_axis(values, order, axis=1)
        fresh_sorted = np.ones_like(ranked, dtype=bool)
        fresh_sorted[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        fresh = np.empty_like(fresh_sorted)
        np.put_along_axis(fresh, order, fresh_sorted, axis=1)
        seen = np.cumsum(fresh, axis=1)
        done = seen[:, -1] >= n
        take = fresh & (seen <= n)
        if done.any():
            out[todo[done]] = np.sort(
                values[done][take[done]].reshape(int(done.sum()), n), axis=1
            )
        todo = todo[~done]
        count *= 2
    return out

"""Words, word hashes and shingle hashes of whole Arrow text columns, in numpy.

A word is a run of digits, ASCII letters and non-ASCII bytes, with A-Z lowered.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SHINGLE = 5
SLICE_BYTES = 1 << 21


def in_worker(name: str, build: Callable):
    """Built once per Python worker, whichever task asks first."""
    held = sys.modules.setdefault("_rankfield_held", types.ModuleType("_rankfield_held")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    held = in_worker("powers", dict)
    if len(held.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            held[name] = np.cumprod(out, dtype=U)
    return held["up"], held["down"]


def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASE) + U(seed))


def prefix_hash(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    """p with range_hash(p, a, b) a hash of buf[a:b] that depends on those bytes only."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_byte_codes(seed)[buf] * up[: len(buf)], out=out[1:])
    return out


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text begins; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece hold ``limit`` bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts (``buf`` lowered), and the first word of each text
    (one more entry than texts)."""
    is_word = word_table()[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = is_word[:-1]
    edges = at[(at > 0) & (at < len(buf))]
    before[edges] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = is_word[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(column: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text."""
    buf, at = text_bytes(column)
    buf = lower_table()[buf]
    starts, ends, first = words(buf, at)
    return range_hash(prefix_hash(buf, seed), starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE):
    """(text number, hash) of all runs of ``size`` words; a text of fewer, but some, words is one run."""
    n, counts = len(hashes), np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    odd = [U(pow(BASE, 2 * k + 3, 1 << 64)) for k in range(size)]
    run = np.full(max(n - size + 1, 0), size, U)
    for k in range(size):
        run += hashes[k : k + len(run)] * odd[k]
    inside = (np.arange(len(run)) + size) <= first[1:][text[: len(run)]]
    who, what = text[: len(run)][inside], mix(run[inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = counts[short].astype(U)
        for k in range(size - 1):
            has = counts[short] > k
            value[has] += hashes[first[short[has]] + k] * odd[k]
        who, what = np.concatenate([who, short]), np.concatenate([what, mix(value)])
    return who, what


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

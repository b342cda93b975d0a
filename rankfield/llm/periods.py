"""Periodic runs of words by internal pattern matching.

The documents of a batch stand in one array of word numbers. Blocks of 2^k words, one every half block, ask for their
next occurrence within a block's length: the suffix array holds a block's occurrences in one interval, and a wavelet
matrix over it gives the smallest occurrence after a place. A next occurrence ``d`` words on means that block and
occurrence together have the smallest period ``d``, the step of the progression of occurrences; the stretch is extended
both ways and kept where it is long enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import slices

LEAST_WORDS = 6
LEAST_TURNS = 4  # periods that a run holds; blocks are dense enough from 4 on
BATCH_BYTES = 1 << 20


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ``ranks[k][i]`` is the first place, in the suffix array, of the suffixes that share their
    first 2^k words with suffix ``i``. Prefix doubling; only suffixes that are not yet alone are sorted again.

    ``t`` has to end with a value of its own, and so has every document in it."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = t[order[1:]] != t[order[:-1]]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    ranks, width = [rank], 1
    alone = first & np.append(first[1:], True)
    open_ = np.flatnonzero(~alone)  # places whose suffix shares its prefix with a neighbour
    while len(open_):
        who = order[open_]
        key = rank[who] * n + rank[who + width]
        by = np.argsort(key, kind="stable")
        order[open_] = who[by]
        key = key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        ranks.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return order, ranks


class WaveletMatrix:
    """Range successor over an array of distinct numbers below its length, for many questions at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        kind = np.int32 if self.n < 1 << 31 else np.int64
        for b in reversed(range(self.n.bit_length())):  # of n itself too: a question may ask for values above the last one
            one = (values >> b) & 1 == 1
            zeros = np.zeros(self.n + 1, kind)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((b, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo..hi (exclusive) are below ``x``."""
        count = np.zeros(len(lo), np.int64)
        for b, zeros, total in self.levels:
            l0, h0 = zeros[lo], zeros[hi]
            one = (x >> b) & 1 == 1
            count += np.where(one, h0 - l0, 0)
            lo = np.where(one, total + lo - l0, l0)
            hi = np.where(one, total + hi - h0, h0)
        return count

    def at_order(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value (from 0) of places lo..hi."""
        value = np.zeros(len(lo), np.int64)
        for b, zeros, total in self.levels:
            l0, h0 = zeros[lo], zeros[hi]
            one = nth >= h0 - l0
            nth = np.where(one, nth - (h0 - l0), nth)
            value |= np.where(one, 1 << b, 0)
            lo = np.where(one, total + lo - l0, l0)
            hi = np.where(one, total + hi - h0, h0)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest value above ``after`` of places lo..hi, -1 where there is none."""
        below = self.smaller(lo, hi, after + 1)
        has = below < hi - lo
        out = np.full(len(lo), -1, np.int64)
        out[has] = self.at_order(lo[has], hi[has], below[has])
        return out


def _extended(ranks: list[np.ndarray], i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the longest stretches around ``i`` in which words ``d`` apart are the same. No match is as long as the
    longest rank's blocks, so each length of block is tried once."""
    n = len(ranks[0])
    right, left = i.copy(), i.copy()
    for k in reversed(range(len(ranks) - 1)):
        rank, m = ranks[k], 1 << k
        a = np.minimum(right, n - 1)
        same = (right + d < n) & (rank[a] == rank[np.minimum(right + d, n - 1)])
        right = np.where(same, right + m, right)
        a = np.maximum(left - m, 0)
        same = (left >= m) & (rank[a] == rank[a + d])
        left = np.where(same, left - m, left)
    return left, right + d


def runs_of(
    t: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``t``, by start, then period; see :func:`suffix_array` on what ``t`` is.

    A run of period q is seen by blocks of m = 2^k >= q words, one every m / 2: its stretch of 4q words at least holds
    such a block and its copy q words on, and a block no shorter than q has no nearer copy inside a run of smallest
    period q. Blocks short enough for every smaller period to be seen by longer ones are left out."""
    if least_turns < 4:
        raise ValueError("blocks are dense enough for runs of at least 4 periods")
    none = np.empty(0, np.int64)
    if len(t) < least_words:
        return none, none, none
    order, ranks = suffix_array(t)
    n = len(t)
    # the longest block that fits, with its copy, into the shortest run of every period up to its length
    k0 = 0
    while all(
        3 * (1 << k0) + q - 1 <= max(least_words, least_turns * q) for q in range(1, (2 << k0) + 1)
    ):  # a block of 2^(k0+1) words every 2^k0
        k0 += 1
    asks = []
    for k in range(k0, len(ranks)):
        step = max(1, (1 << k) // 2)
        start = np.arange(0, n, step)
        lo = ranks[k][start]
        size = np.bincount(ranks[k], minlength=n)[lo]
        some = size > 1
        asks.append((start[some], lo[some], lo[some] + size[some], np.full(int(some.sum()), 1 << k)))
    start, lo, hi, m = (np.concatenate([a[j] for a in asks]) if asks else none for j in range(4))
    if not len(start):
        return none, none, none
    nearest = WaveletMatrix(order).successor(lo, hi, start)
    d = nearest - start
    near = (nearest >= 0) & (d <= m)
    start, d = start[near], d[near]
    begin, end = _extended(ranks, start, d)
    long = end - begin >= np.maximum(least_words, least_turns * d)
    found = np.unique(np.stack([begin[long], d[long], end[long]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _scan(rewrite: Callable | None, least_words: int, least_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BATCH_BYTES):
            ids = part.column("doc_id").to_pylist()
            docs = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            if rewrite:
                docs = [rewrite(i, w) for i, w in zip(ids, docs)]
            number: dict[bytes, int] = {}
            size = np.array([len(w) for w in docs])
            at = np.concatenate([[0], np.cumsum(size + 1)])  # each document ends with a number of its own
            t = np.empty(at[-1], np.int64)
            for k, w in enumerate(docs):
                t[at[k] : at[k] + len(w)] = [number.setdefault(x, len(number)) for x in w]
            t[at[1:] - 1] = len(number) + np.arange(len(docs))
            begin, end, period = runs_of(t, least_words, least_turns)
            doc = np.searchsorted(at, begin, "right") - 1
            cover = np.zeros(len(t) + 1, np.int64)
            np.add.at(cover, begin + period, 1)
            np.add.at(cover, end, -1)
            gone = np.cumsum(cover) > 0
            bounds = np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32)
            text = []
            for k, w in enumerate(docs):
                if bounds[k] < bounds[k + 1]:
                    w = [w[j] for j in np.flatnonzero(~gone[at[k] : at[k] + len(w)])]
                text.append(b" ".join(w).decode())
            runs = pa.StructArray.from_arrays(
                [pa.array(begin - at[doc]), pa.array(end - begin), pa.array(period)], ["start", "length", "period"]
            )
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(size.astype(np.int64)),
                    "runs": pa.ListArray.from_arrays(pa.array(bounds), runs),
                    "collapsed": pa.array(text, pa.string()),
                }
            )

    return run


def periodic_runs(
    docs: DataFrame,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    least_words: int = LEAST_WORDS,
    least_turns: int = LEAST_TURNS,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs(doc_id, text)``.

    A word is a run without ASCII white space. ``runs`` lists (start, length, period) of every longest stretch of words
    whose smallest period is ``period`` and that holds ``least_words`` words and ``least_turns`` periods at least, by start,
    then period. ``collapsed`` keeps, of each run, the first ``period`` words; words are joined by one blank.
    ``rewrite(doc_id, words)`` may change a text's words before they are looked at.

    NULL, empty and wordless texts have no words, no runs and an empty ``collapsed``. Repeated rows are looked at one by
    one, rows without doc_id too; other columns are ignored. Texts share arrays in batches of about 1 MB; a longer text is
    a batch of its own, at about 0.3 KB of memory a word.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(rewrite, least_words, least_turns),
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten repeat from some place on, with a period of at most a third of the rest; which
    documents, places and periods follows from a checksum of the doc_id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of :func:`periodic_runs`:
    the longest run (ties: the first, then the shortest period) and checksums of all runs and of the kept words."""

    def longer(a: Column, b: Column) -> Column:
        return F.when(a["length"].isNull() | (b["length"] > a["length"]), b).otherwise(a)

    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    empty = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return found.withColumn("top", F.aggregate("runs", empty, longer)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

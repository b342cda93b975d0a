"""Suffix-array dedup with a run-length index.

A byte goes if a 100-byte string that covers it also starts earlier in the corpus. Equal 100-byte strings
hold the same minimiser, their smallest 32-byte gram, at the same place. So a text is cut into contexts,
the bytes of all windows with one minimiser, and only contexts of equal grams can share a window:

1. An occurrence of a context that is not its first goes with all its windows.
2. First occurrences of different contexts around the same gram meet in a run-length index: their
   Burrows-Wheeler transform, kept as runs, with text positions sampled where runs and matches end. Texts are
   streamed back through it from their ends, with the place of their earliest match of 100 bytes at each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .wordhash import U, prefix_hash, range_hash, signed, slices, text_bytes

LENGTH = 100
GRAM = 32
FLUSH = 1_000_000  # contexts that a task combines before it hands them on
INDEX_BYTES = 500_000  # text of one index, about
CROWDED = 5_000  # contexts of one gram above which its windows are compared by hash, in many tasks


def _anchors(buf: np.ndarray, at: np.ndarray, p: np.ndarray):
    """(text number, first window, windows, gram's place) of every context of the texts; places in ``buf``."""
    n, reach = len(buf), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 4
    start = np.arange(n - GRAM + 1)
    h = range_hash(p, start, start + GRAM)
    # The gram's hash, then its place: of equal grams in a window the leftmost counts.
    bits = max(1, int(n).bit_length())
    key = (h >> U(bits)) << U(bits) | start.astype(U)
    low, width = key, 1
    while width * 2 <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[reach - width : reach - width + n - LENGTH + 1])
    place = (low & U((1 << bits) - 1)).astype(np.int64)
    window = np.arange(len(place))
    text = np.searchsorted(at, window, "right") - 1
    valid = window + LENGTH <= at[text + 1]
    window, text, place = window[valid], text[valid], place[valid]
    if not len(window):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    return text[first], window[first], np.diff(np.append(first, len(window))), place[first]


def _pack(first: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (first << 14) | (before << 7) | windows


def _unpack(loc: np.ndarray):
    return loc >> 14, (loc >> 7) & 127, loc & 127


_ROWS = "gram long, ctx long, doc_id long, loc long, gone boolean"


def _rows(gram, ctx, doc, loc, gone) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "gram": pa.array(gram.view(np.int64)),
            "ctx": pa.array(ctx.view(np.int64)),
            "doc_id": pa.array(doc),
            "loc": pa.array(loc),
            "gone": pa.array(np.full(len(gram), gone)),
        }
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a task's texts; of equal ones all but the first are gone already."""
    held: list[tuple] = []

    def flush():
        gram, ctx, doc, loc = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((loc, doc, ctx, gram))
        gram, ctx, doc, loc = gram[order], ctx[order], doc[order], loc[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))
        later = (doc != doc[lead]) | (loc != loc[lead])
        yield _rows(gram[first], ctx[first], doc[first], loc[first], False)
        yield _rows(gram[later], ctx[later], doc[later], loc[later], True)

    for part in slices(batches, "text", 1 << 20):
        buf, at = text_bytes(part.column("text"))
        p = prefix_hash(buf)
        text, first, windows, place = _anchors(buf, at, p)
        if not len(text):
            continue
        gram = range_hash(p, place, place + GRAM)
        ctx = range_hash(p, first, first + windows + LENGTH - 1)
        ids = np.asarray(part.column("doc_id"))
        held.append((gram, ctx ^ (place - first).astype(U), ids[text], _pack(first - at[text], place - first, windows)))
        if sum(len(x[0]) for x in held) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (gram, ctx, doc_id, loc): later rows of a context are gone; first rows stay where their
    gram has several contexts, and are left out where it has one."""
    last: tuple | None = None  # (gram, ctx, doc, loc) of the first row of the context seen last
    pending = False  # whether its gram has no other context so far
    for part in batches:
        gram, ctx, doc, loc = (np.asarray(part.column(c)) for c in ("gram", "ctx", "doc_id", "loc"))
        if not len(gram):
            continue
        if last is not None:
            gram, ctx, doc, loc = (np.concatenate([[np.int64(x)], y]) for x, y in zip(last, (gram, ctx, doc, loc)))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
        later = (doc != doc[lead]) | (loc != loc[lead])
        yield _rows(gram[later], ctx[later], doc[later], loc[later], True)
        rep = np.flatnonzero(new)
        group = np.concatenate([[0], np.cumsum(gram[rep][1:] != gram[rep][:-1])])
        several = np.bincount(group)[group] > 1
        if last is not None:
            # The carried row went out already unless it is pending.
            if not pending:
                several[group == 0] = True
                several[0] = False
        out = rep[several]
        yield _rows(gram[out], ctx[out], doc[out], loc[out], False)
        alone = (group == group[-1]).sum() == 1
        if not (alone and last is not None and group[-1] == 0):
            pending = alone
        tail = rep[-1]
        last = (gram[tail], ctx[tail], doc[tail], loc[tail])


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, each ended by a sign of its own.

    ``run``: first row of each run of equal preceding signs; ``jump``: the row that the run's first row
    leads to when its text is read one sign further back.

    Rows that agree in 100 bytes are a group. Mostly a group is another one read one sign back: all of that
    group's rows lie in one run, and nothing joins them. Its smallest text position is then that of the other
    less one. Only the groups where this fails, at the ends of runs and of matches, are sampled: ``begin``,
    ``until`` (rows) and ``sample`` (smallest text position). Nothing kept is as long as the texts.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts])
        self.end = np.cumsum(sizes) - 1  # place of each text's end sign
        n = int(sizes.sum())
        sign = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
        sign[self.end] = np.arange(len(texts))
        order, same = _sorted_suffixes(sign)
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.row_of_end = row[self.end]
        before = sign[order - 1]
        first = np.ones(n, bool)
        first[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(first)
        length = np.diff(np.append(self.run, n))
        head = before[self.run]
        by_head = np.argsort(head, kind="stable")
        self.jump = np.empty(len(self.run), np.int64)
        self.jump[by_head] = np.concatenate([[0], np.cumsum(length[by_head])[:-1]])

        group = np.flatnonzero(~same)
        size = np.diff(np.append(group, n))
        number = np.repeat(np.arange(len(group)), size)
        # The group of each row's text one sign further on; a text's end has none and is where reading begins.
        ahead = number[row[np.minimum(order + 1, n - 1)]]
        low, high = np.minimum.reduceat(ahead, group), np.maximum.reduceat(ahead, group)
        sampled = (low != high) | (size[low] != size)
        self.begin, self.until = group[sampled], (group + size)[sampled]
        self.sample = np.minimum.reduceat(order, group)[sampled]

    def back(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin one sign earlier."""
        run = np.searchsorted(self.run, row, "right") - 1
        return self.jump[run] + row - self.run[run]

    def earliest(self, row: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Smallest text position that agrees with ``row`` in 100 bytes: the sample of its group, else ``follows``."""
        if not len(self.begin):
            return follows
        k = np.maximum(np.searchsorted(self.begin, row, "right") - 1, 0)
        return np.where((self.begin[k] <= row) & (row < self.until[k]), self.sample[k], follows)

    def matches(self) -> np.ndarray:
        """Matching statistics of the texts, at 100 bytes: for every text position the smallest position
        whose 100 bytes equal those from there, itself where nothing earlier does. All texts are streamed
        side by side, from their ends back."""
        out = np.arange(self.end[-1] + 1)
        begin = np.append(0, self.end[:-1] + 1)
        row, at, first = self.row_of_end, self.end, self.end
        active = at > begin
        while active.any():
            row, at, begin, first = row[active], at[active], begin[active], first[active]
            row, at = self.back(row), at - 1
            first = self.earliest(row, first - 1)
            out[at] = first
            active = at > begin
        return out

    def earlier_matches(self) -> np.ndarray:
        """For every text position, whether the 100 bytes from there also begin at a smaller position."""
        found = self.matches()
        return found < np.arange(len(found))


def _sorted_suffixes(sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and for each row whether it agrees in ``LENGTH`` signs with the row above."""
    n = len(sign)
    rank, width = sign.astype(U) + U(1), 1
    half = None
    if sign.max() < (1 << 16) - 1:  # four signs at once
        ahead = np.concatenate([rank, np.zeros(3, U)])
        rank, width = ahead[:n] << U(48) | ahead[1 : n + 1] << U(32) | ahead[2 : n + 2] << U(16) | ahead[3:], 4
        order = np.argsort(rank)
        new = np.ones(n, bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        rank[order] = (np.cumsum(new) - 1).astype(U)
    while True:
        if width == 64:
            half = rank.copy()
        shifted = np.zeros(n, U)
        shifted[: max(n - width, 0)] = rank[width:] + U(1)
        key = rank << U(32) | shifted
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, U)
        rank[order] = (np.cumsum(new) - 1).astype(U)
        width *= 2
        if width >= 2 * 64 and (new.all() or width >= n):
            break
    rest = LENGTH - 64
    later = np.zeros(n, U)
    later[: max(n - rest, 0)] = half[rest:] + U(1)
    a, b = half[order], later[order]
    same = np.zeros(n, bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, same


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, doc_id, loc, bytes) in order of gram: indexes whole grams, ``INDEX_BYTES`` at a time."""
    held: list[pa.Table] = []
    size = 0

    def flush(table: pa.Table):
        doc, loc = np.asarray(table.column("doc_id")), np.asarray(table.column("loc"))
        order = np.lexsort((loc, doc))  # text positions then ascend as the corpus does
        one = np.ones(len(order), bool)  # repeated rows of a document give a context once
        one[1:] = (doc[order][1:] != doc[order][:-1]) | (loc[order][1:] != loc[order][:-1])
        order = order[one]
        data = table.column("bytes").to_pylist()
        index = RunLengthIndex([data[k] for k in order])
        found = index.earlier_matches()
        begin = np.append(0, index.end[:-1] + 1)
        first, _, windows = _unpack(loc[order])
        # Runs of windows that go, context by context.
        mark = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        up, down = np.flatnonzero(mark == 1), np.flatnonzero(mark == -1)
        text = np.searchsorted(begin, up, "right") - 1
        yield _rows(
            np.zeros(len(up), np.int64), np.zeros(len(up), np.int64), doc[order][text],
            _pack(first[text] + up - begin[text], 0 * up, down - up), True,
        )

    for part in batches:
        if not part.num_rows:
            continue
        held.append(pa.Table.from_batches([part]))
        size += part.column("bytes").nbytes
        if size >= INDEX_BYTES:
            table = pa.concat_tables(held).combine_chunks()
            gram = np.asarray(table.column("gram"))
            start = 0
            while True:
                # As many whole grams as make one index; the last gram may go on in the next batch.
                lengths = np.cumsum(np.asarray(pa.compute.binary_length(table.column("bytes").combine_chunks()))[start:])
                cut = start + int(np.searchsorted(lengths, INDEX_BYTES))
                if cut >= len(gram):
                    break
                edge = int(np.searchsorted(gram, gram[cut])) if gram[cut] != gram[start] else int(np.searchsorted(gram, gram[cut], "right"))
                if edge >= len(gram):
                    break
                yield from flush(table.slice(start, edge - start))
                start = edge
            held = [table.slice(start)]
            size = int(lengths[-1]) if len(lengths) else 0
    if held:
        table = pa.concat_tables(held).combine_chunks()
        if table.num_rows:
            yield from flush(table)


def _context_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        buf, at = text_bytes(part.column("text"))
        raw = buf.tobytes()
        doc = part.column("doc_id")
        counts = np.asarray(part.column("locs").value_lengths())
        flat = part.column("locs").flatten()
        gram, loc = np.asarray(flat.field("gram")), np.asarray(flat.field("loc"))
        first, _, windows = _unpack(loc)
        begin = np.repeat(at[:-1], counts) + first
        end = np.minimum(begin + windows + LENGTH - 1, np.repeat(at[1:], counts))
        yield pa.record_batch(
            {
                "gram": pa.array(gram),
                "doc_id": pa.array(np.repeat(np.asarray(doc), counts)),
                "loc": pa.array(loc),
                "bytes": pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()),
            }
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of every single window of crowded grams' contexts."""
    for part in slices(batches, "bytes", 1 << 18):
        buf, at = text_bytes(part.column("bytes"))
        first, _, windows = _unpack(np.asarray(part.column("loc")))
        number = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(at[:-1], windows) + number
        row = np.repeat(np.arange(part.num_rows), windows)
        yield pa.record_batch(
            {
                "h1": signed(range_hash(prefix_hash(buf), start, start + LENGTH)),
                "h2": signed(range_hash(prefix_hash(buf, 7), start, start + LENGTH)),
                "doc_id": pa.array(np.asarray(part.column("doc_id"))[row]),
                "first": pa.array(first[row] + number),
            }
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        buf, at = text_bytes(part.column("text"))
        n = part.num_rows
        locs = part.column("locs")
        counts = np.asarray(locs.value_lengths().fill_null(0))
        first, _, windows = _unpack(np.asarray(locs.flatten()))
        row = np.repeat(np.arange(n), counts)
        start = at[row] + first
        end = np.minimum(start + windows + LENGTH - 1, at[row + 1])
        ok = start < end
        cover = np.zeros(len(buf) + 1, np.int64)
        np.add.at(cover, start[ok], 1)
        np.add.at(cover, end[ok], -1)
        gone = np.cumsum(cover)[: len(buf)] > 0
        before = np.concatenate([[False], gone[:-1]])[: len(buf)]
        heads = at[:-1][np.diff(at) > 0]
        before[heads] = False
        removed = np.concatenate([[0], np.cumsum(gone)])
        begun = np.concatenate([[0], np.cumsum(gone & ~before)])
        sums = []
        for k in range(n):
            a, b = at[k], at[k + 1]
            kept = buf[a:b] if removed[a] == removed[b] else buf[a:b][~gone[a:b]]
            sums.append(hashlib.sha256(kept.tobytes()).hexdigest())
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "n_bytes": pa.array(np.diff(at)),
                "n_removed": pa.array(np.diff(removed[at])),
                "n_spans": pa.array(np.diff(begun[at])),
                "kept_sha256": pa.array(sums),
            }
        )


def remove_repeated_bytes(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, NULL is empty. A byte is removed if it lies in a 100-byte string that also
    starts earlier: in a document of smaller doc_id, or earlier in the same one, overlaps included. ``n_spans`` counts
    maximal removed runs; ``kept_sha256`` hashes the other bytes in a row.

    Texts under 100 bytes stay whole. Rows repeating a doc_id with its text are one document: each gives the
    same row; where their texts differ, each loses what any of them repeats at that place. Rows without doc_id stay whole.
    Other columns are ignored.

    A task combines equal contexts before it hands them on, so that a passage of every document costs a row
    per task. Contexts of a gram that more than ``crowded`` different contexts surround would not fit one
    index; their windows are compared by a 128-bit hash, aggregated in many tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_id = docs.filter("doc_id is not null")
    rows = with_id.mapInArrow(_contexts, _ROWS)
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    gone_early = F.col("gone")
    dealt = (
        rows.withColumn("deal", F.when(gone_early, F.col("doc_id")).otherwise(F.col("gram")))
        .repartition(int(parts), "deal")
        .sortWithinPartitions("gone", "gram", "ctx", "doc_id", "loc")
        .drop("deal")
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First rows are compared; rows gone before pass."""

        def open_rows(batches, done):
            for part in batches:
                gone = np.asarray(part.column("gone"))
                if gone.any():
                    done.append(part.filter(pa.array(gone)))
                if not gone.all():
                    yield part.filter(pa.array(~gone))

        done: list[pa.RecordBatch] = []
        for out in _first_of_each(open_rows(batches, done)):
            yield out
            while done:
                yield done.pop()
        while done:
            yield done.pop()

    settled = stage(dealt.mapInArrow(settle, _ROWS).select("gram", "doc_id", "loc", "gone"), "contexts")
    open_ = settled.filter("not gone")
    crowd = open_.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > crowded)
    crowd = stage(crowd.select(F.col("gram").alias("_gram")), "crowded-grams")

    locs = open_.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "loc")).alias("locs"))
    texts = with_id.join(locs.hint("merge"), "doc_id").select("doc_id", "text", "locs")
    contexts = stage(
        texts.mapInArrow(_context_bytes, "gram long, doc_id long, loc long, bytes binary"), "context-bytes"
    )
    found = (
        contexts.join(crowd, F.col("gram") == F.col("_gram"), "left_anti")
        .repartition(int(parts), "gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_indexed, _ROWS)
        .select("doc_id", "loc")
    )
    window = (
        contexts.join(crowd, F.col("gram") == F.col("_gram"), "left_semi")
        .select("doc_id", "loc", "bytes")
        .mapInArrow(_windows, "h1 long, h2 long, doc_id long, first long")
    )
    earliest = window.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("e"))
    crowded_gone = (
        window.join(earliest, ["h1", "h2"])
        .filter("doc_id > e.doc_id or (doc_id = e.doc_id and first > e.first)")
        .select("doc_id", F.shiftleft("first", 14).bitwiseOR(F.lit(1)).alias("loc"))
    )
    gone = settled.filter("gone").select("doc_id", "loc").union(found).union(crowded_gone)
    places = stage(
        gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("loc").alias("locs")), "removed-runs"
    )
    return (
        docs.join(places.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
        .select("doc_id", "text", "locs")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )

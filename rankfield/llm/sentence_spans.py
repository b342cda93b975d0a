"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences is hashed; a run found earlier elsewhere is a repeat, and sentences
covered by a repeat are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .wordhash import U, lower_table, mix, powers, prefix_hash, range_hash, signed, slices, text_bytes, words

SENTENCES = 3  # of a span, at least
WORDS = 15  # of a span, at least
WINDOW = 8  # words; each run of so many holds the end of a sentence or of a part

_ENDS = b".!?\n"


def _marks(signs: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(signs)] = 1
    return t


def spans(column: pa.Array):
    """Sentences (or their parts) and spans of texts, as a dict of arrays; spans by text, start and end.

    ``sentence``: number of each sentence's text; ``begin``: its first byte in its text (0 for a text's
    first; a sentence ends where the next one begins); ``words``: its words; ``first``: first sentence of each text; ``start``, ``end``:
    the sentences of each span, end exclusive; ``spans``: first span of each text; ``h1``, ``h2``: its hashes; ``text``: its text; ``repeat``: whether
    its text has an equal span earlier.
    """
    buf, at = text_bytes(column)
    low = lower_table()[buf]
    w_start, w_end, w_first = words(low, at)
    h = range_hash(prefix_hash(low), w_start, w_end)
    n = len(h)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(w_first))
    if not n:
        none = np.empty(0, np.int64)
        return dict(sentence=none, begin=none, words=none, first=np.zeros(len(at), np.int64), start=none, end=none,
                    spans=np.zeros(len(at), np.int64), h1=none.view(U), h2=none.view(U), text=none, repeat=none.astype(bool), at=at)

    def marked(signs: bytes) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(_marks(signs)[buf])])
        out = np.zeros(n, bool)
        out[1:] = seen[w_start[1:]] > seen[w_end[:-1]]
        return out

    opens = marked(_ENDS)
    opens[w_first[:-1][np.diff(w_first) > 0]] = True
    natural = np.append(opens, True)  # whether a sentence ends in front of a word
    # A window of words without a sentence's end is cut behind its smallest hash. A cut depends on its window only, and a
    # window that reaches over a sentence's bounds makes none of its own: equal passages and equal sentences are cut alike.
    if n >= WINDOW:
        key = np.where(natural[1:], U(0), h | U(1))
        place = np.arange(n - WINDOW + 1)
        inside = text_of[place] == text_of[place + WINDOW - 1]
        least = place + np.lib.stride_tricks.sliding_window_view(key, WINDOW).argmin(axis=1)
        least = least[inside]
        opens[least[least + 1 < n] + 1] = True
    head = np.flatnonzero(opens)
    text = text_of[head]
    first = np.searchsorted(text, np.arange(len(at)))
    begin = w_start[head] - at[text]
    begin[first[:-1][np.diff(first) > 0]] = 0
    bounds = np.append(head, n)

    number = np.arange(len(head))
    end = np.maximum(np.searchsorted(bounds, head + WORDS), number + SENTENCES)
    whole = end <= first[1:][text]
    # The last words of repeated sentences may be too few for a span that starts there: one more ends with each sentence.
    last = np.flatnonzero(natural[bounds[1:]]) + 1
    back = np.minimum(np.searchsorted(bounds, bounds[last] - WORDS, "right") - 1, last - SENTENCES)
    full = back >= first[:-1][text[last - 1]]
    pair = np.unique(np.concatenate([number[whole] * (n + 1) + end[whole], back[full] * (n + 1) + last[full]]))
    start, end = pair // (n + 1), pair % (n + 1)
    text_s = text[start]
    out = []
    for salt in (U(0), U(0xA5A5A5A5A5A5A5A5)):
        up, down = powers(n + 1)
        p = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ salt) * up[:n])])
        a, b = bounds[start], bounds[end]
        out.append(mix((p[b] - p[a]) * down[a] + (b - a).astype(U)))
    order = np.lexsort((start, out[0], text_s))
    repeat = np.zeros(len(start), bool)
    same = (text_s[order][1:] == text_s[order][:-1]) & (out[0][order][1:] == out[0][order][:-1])
    repeat[order[1:]] = same
    return dict(sentence=text, begin=begin, words=np.diff(bounds), first=first, start=start, end=end,
                spans=np.searchsorted(text_s, np.arange(len(at))), h1=out[0], h2=out[1], text=text_s, repeat=repeat, at=at)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        s = spans(part.column("text"))
        own = ~s["repeat"]
        ids = np.asarray(part.column("doc_id"))
        yield pa.record_batch(
            {
                "h1": signed(s["h1"][own]),
                "h2": pa.array((s["h2"][own] >> U(32)).astype(np.uint32).view(np.int32)),
                "doc_id": pa.array(ids[s["text"][own]]),
            }
        )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        s = spans(part.column("text"))
        n, m = part.num_rows, len(s["begin"])
        repeats = part.column("repeats")
        flagged = s["repeat"].copy()
        counts = np.asarray(repeats.value_lengths().fill_null(0))
        if counts.any():
            known = np.asarray(repeats.flatten()).view(U)
            # a span's hash together with its row, so that rows do not take each other's repeats
            row = mix(np.arange(n, dtype=U))
            flagged |= np.isin(s["h1"] ^ row[s["text"]], known ^ np.repeat(row, counts))
        cover = np.zeros(m + 1, np.int64)
        np.add.at(cover, s["start"][flagged], 1)
        np.add.at(cover, s["end"][flagged], -1)
        gone = np.cumsum(cover)[:m] > 0
        kept, texts = [], part.column("text").to_pylist()
        for k in range(n):
            a, b = s["first"][k], s["first"][k + 1]
            if texts[k] is None or not gone[a:b].any():
                kept.append(texts[k])
                continue
            raw = texts[k].encode()
            edge = np.append(s["begin"][a:b], len(raw))
            kept.append(b"".join(raw[edge[i] : edge[i + 1]] for i in np.flatnonzero(~gone[a:b])).decode())
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "n_sentences": pa.array(np.diff(s["first"])),
                "n_removed": pa.array(np.bincount(s["sentence"], gone, n).astype(np.int64)),
                "n_words_removed": pa.array(np.bincount(s["sentence"], gone * s["words"], n).astype(np.int64)),
                "text": pa.array(kept, pa.string()),
            }
        )


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_words_removed, text) of every row of ``docs(doc_id, text)``.

    A sentence ends at a full stop, question or exclamation mark or line end between two words. Each run of 8 words
    without such an end is cut behind the word of the smallest hash, and the parts count as sentences. A span starts at
    every part and takes the fewest parts that make 3 parts and 15 words; another one ends with every sentence. A passage
    of over 50 words holds a span of its own wherever it stands. Spans are equal if their words
    are, case and punctuation aside; the first is the one of the smallest doc_id, then the earliest. Every sentence
    inside another one of a span's occurrences is removed together with what follows it up to the next
    sentence; ``text`` keeps the rest as it was.

    NULL texts stay NULL; empty, wordless and very short texts have no spans and stay. Rows of one doc_id
    count as one document, whether their texts are equal or not, and are not removed against each other: a span that
    another document has first is removed from all of them. Rows without doc_id lose only
    what they repeat themselves. Other columns are ignored.
    Spans are equal if 96 bits of their words' hashes are, 64 bits within a document.

    A document sends each of its hashes once; hashes are made twice instead of being stored. A hash that many documents share is aggregated before it is
    shuffled, and its rows are split over tasks where they are joined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = docs.filter("doc_id is not null").mapInArrow(_hashes, "h1 long, h2 int, doc_id long")
    shared = (
        table.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("h1", "h2", "first_id")
    )
    found = table.join(shared, ["h1", "h2"]).filter("doc_id <> first_id").select("doc_id", "h1")
    repeats = stage(
        found.groupBy("doc_id").agg(F.collect_list("h1").alias("repeats")).withColumnRenamed("doc_id", "_doc"),
        "repeated-spans",
    )
    return (
        docs.join(repeats.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
        .select("doc_id", "text", "repeats")
        .mapInArrow(_clean, "doc_id long, n_sentences long, n_removed long, n_words_removed long, text string")
    )

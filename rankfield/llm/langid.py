"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .wordhash import BASE, U, in_worker, mix, slices, text_bytes

BUCKETS = 1 << 14
GRAMS = (1, 2, 3, 4)  # characters
FOLDS = 5
SMOOTHING = 0.1
UNKNOWN = "und"
LANGUAGES = 2_000  # languages of a model, at most; more than there are codes in ISO 639's larger parts in use
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def _signs() -> np.ndarray:
    """The sign every character counts as: in lower case where that is one character; digits, white space and
    ASCII punctuation before the letters are all one sign."""
    lowered = (chr(c).lower() for c in range(sys.maxunicode + 1))
    out = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(lowered)], np.uint32)
    out[:65] = 32
    return out


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All signs of the texts in a row, and where each text begins; NULL is empty."""
    buf, at = text_bytes(column)
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    return in_worker("langid-signs", _signs)[points], begins[at]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of characters."""
    signs, at = characters(column)
    signs = signs.astype(U)
    n = len(signs)
    who, what = [], []
    value = np.zeros(n, U)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    last = np.repeat(at[1:], np.diff(at))
    for size in range(1, max(GRAMS) + 1):
        m = max(n - size + 1, 0)
        value = mix(value[:m] * U(BASE) + signs[size - 1 : size - 1 + m] + U(1))
        if size in GRAMS:
            inside = np.arange(m) + size <= last[:m]
            who.append(text[:m][inside])
            what.append((value[inside] & U(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(who), np.concatenate(what)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for part in slices(batches, "text"):
        who, what = grams(part.column("text"))
        langs = part.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        n = np.bincount(code[who] * BUCKETS + what, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
        for k, name in enumerate(names):
            total[name] = total.get(name, 0) + n[k]
            texts[name] = texts.get(name, 0) + langs.count(name)
    for name, n in total.items():
        at = np.flatnonzero(n)
        # Bucket -1 counts the texts.
        yield pa.record_batch(
            {
                "lang": pa.array([name] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1)),
                "n": pa.array(np.append(n[at], texts[name])),
            }
        )


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix, log-prior) from all rows of ``docs(text, lang)`` with a lang and a
    text. The matrix has a row per language and a column per bucket; its size depends on neither
    rows nor texts."""
    counted = (
        docs.filter("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    counted = stage(counted, "gram-counts")
    names = [r.lang for r in counted.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different values of lang")
    matrix = np.zeros((len(names), BUCKETS))
    prior = np.ones(len(names))
    place = {x: k for k, x in enumerate(names)}
    for r in counted.toLocalIterator():
        if r.bucket < 0:
            prior[place[r.lang]] = r.n
        else:
            matrix[place[r.lang], r.bucket] = r.n
    matrix = np.log(matrix + SMOOTHING) - np.log((matrix + SMOOTHING).sum(axis=1, keepdims=True))
    return names, matrix, np.log(prior / prior.sum()) if names else prior


def has_letter(text: str | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs(doc_id, text)``.

    ``lang_pred`` is the most probable language, ties to the first in alphabetical order; ``score`` its
    share of the per-gram geometric mean likelihoods, between 0 and 1. Texts that are NULL or have no letter, and
    all texts where nothing was learned, are ``und`` with score 0. Repeated rows are judged one by one;
    other columns are ignored.
    """
    names, matrix, prior = model
    held = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(matrix.T.astype(np.float32)), prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_bucket, prior = held.value
        for part in slices(batches, "text", 1 << 20):
            n = part.num_rows
            known = np.array([has_letter(x) for x in part.column("text").to_pylist()]) & bool(names)
            who, what = grams(part.column("text"))
            total = np.zeros((n, max(1, len(names))))
            count = np.bincount(who, minlength=n)
            for k in range(len(names)):
                total[:, k] = np.bincount(who, by_bucket[:, k][what], n) + prior[k]
            best = total.argmax(axis=1)
            mean = (total - total.max(axis=1, keepdims=True)) / np.maximum(count, 1)[:, None]
            score = 1 / np.exp(mean).sum(axis=1)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "lang_pred": pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, known)]),
                    "score": pa.array(np.where(known, score, 0.0)),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows whose crc32(doc_id as text) mod 5 is not 0
    (a NULL doc_id counts as the empty text), predicts every row."""
    text_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    fold = F.crc32(text_id) % FOLDS == 0
    model = train(docs.filter(~fold))
    shown = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    return predict(docs, model).select("doc_id", shown.alias("held_out"), "lang_pred", "score")

"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = logistic(cut[k] - w.x): one weight per feature, shared by all cuts, which are ordered.
A document's features are its distinct words and word beginnings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import sampled, stage
from .wordhash import U, lower_table, mix, prefix_hash, range_hash, signed, slices, text_bytes, words

SAMPLE = 20_000  # labelled documents a model is fitted on, about: those of the smallest hashes of doc_id
PREFIX = 5  # bytes of a word beginning
LEAST = 4  # labelled documents a feature must occur in
LOST = 0.005  # clean labelled documents, out of those held out in training, that may be taken for toxic
REJECT = 0.5  # the probability from which a text is toxic, where no clean document is there to choose it
EVIDENCE = 15.0  # likelihood ratio statistic of feature and label, at least


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weight: np.ndarray
    cuts: np.ndarray  # ascending; one fewer than grades
    reject: float  # a text is toxic from this probability on


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) pairs; a pair may repeat."""
    buf, at = text_bytes(column)
    buf = lower_table()[buf]
    start, end, first = words(buf, at)
    p = prefix_hash(buf)
    who = np.repeat(np.arange(len(at) - 1), np.diff(first))
    long = end - start > PREFIX
    begin = mix(range_hash(p, start[long], start[long] + PREFIX) ^ U(PREFIX))
    return np.concatenate([who, who[long]]), np.concatenate([range_hash(p, start, end), begin])


def _distinct(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[new], what[new]


def _known(model_features: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in the model) of the distinct features that the model has."""
    who, what = features(column)
    at = np.searchsorted(model_features, what)
    at[at == len(model_features)] = 0
    hit = model_features[at] == what if len(model_features) else np.zeros(len(what), bool)
    key = np.unique(who[hit] * (len(model_features) + 1) + at[hit])
    return key // (len(model_features) + 1), key % (len(model_features) + 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        who, what = _distinct(*features(part.column("text")))
        toxic = np.asarray(part.column("toxic")) > 0
        key, place = np.unique(what, return_inverse=True)
        n = np.bincount(place, minlength=len(key))
        bad = np.bincount(place, toxic[who], minlength=len(key)).astype(np.int64)
        yield pa.record_batch({"feature": signed(key), "n": pa.array(n), "bad": pa.array(bad)})


def _evidence(n, bad, all_n: int, all_bad: int):
    """2 log of the likelihood ratio between a feature tied to the label and one independent of it."""

    def part(x, of, rate):
        return F.when(x > 0, x * F.log(x / (of * rate))).otherwise(0.0)

    rest_n, rest_bad = F.lit(all_n) - n, F.lit(all_bad) - bad
    p = all_bad / all_n
    return 2 * (
        part(bad, n, p) + part(n - bad, n, 1 - p) + part(rest_bad, rest_n, p) + part(rest_n - rest_bad, rest_n, 1 - p)
    )


def fit_cumulative(who, what, grade, n_features: int, ridge: float = 2e-4, rounds: int = 800):
    """Weights and ordered cuts of rows given as (row, feature) pairs with ``grade`` 0..K-1 per row, by
    Adam on the penalised mean log-likelihood."""
    k, n = int(grade.max()), len(grade)
    theta = np.zeros(n_features + k)
    theta[n_features] = 3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)

    def cuts_of(t):
        return np.cumsum(np.concatenate([t[n_features : n_features + 1], np.exp(t[n_features + 1 :])]))

    for step in range(1, rounds + 1):
        w, cuts = theta[:n_features], cuts_of(theta)
        score = np.bincount(who, w[what], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - score, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(edge[grade] - score, -40, 40)))
        upper[grade == k], lower[grade == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g = np.zeros_like(theta)
        g[:n_features] = np.bincount(what, (du - dl)[who], n_features) / n + ridge * w
        g_cut = np.zeros(k + 2)
        np.add.at(g_cut, grade + 1, -du / n)
        np.add.at(g_cut, grade, dl / n)
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g[n_features] = tail[0]
        g[n_features + 1 :] = tail[1:] * np.exp(theta[n_features + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return theta[:n_features], cuts_of(theta)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from ``labels(doc_id, toxic)`` joined to ``docs(doc_id, text)``.

    Grades: 0 for rows labelled not toxic; toxic rows are 1, or 2 where they hold more marker features
    (those at least half of whose labelled documents are toxic) than the median toxic row. About
    ``sample`` labelled documents are used, those of the smallest hashes. Rows without doc_id or label
    teach nothing; a doc_id labelled twice is toxic if one label says so. With labels of one kind
    only, the model has no features and grades everything 0.
    """
    said = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("key", F.xxhash64("doc_id"))
    )
    said = sampled(said, "key", sample).drop("key")
    taught = stage(docs.select("doc_id", "text").join(F.broadcast(said), "doc_id"), "toxic-sample")
    total = taught.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    all_n, all_bad = total.n, int(total.bad or 0)
    if not 0 < all_bad < all_n:
        return Model(np.empty(0, U), np.empty(0), np.array([40.0, 41.0]), REJECT)
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    chosen = (
        taught.select("toxic", "text")
        .mapInArrow(_counts, "feature long, n long, bad long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .filter(F.col("n") >= LEAST)
        .withColumn("g", _evidence(n, bad, all_n, all_bad))
        .filter(F.col("g") >= EVIDENCE)
        .select("feature", "n", "bad")
        .collect()  # of ``sample`` documents, and with evidence each
    )
    chosen = sorted((r.feature % (1 << 64), 2 * r.bad >= r.n) for r in chosen)
    known = np.array([f for f, _ in chosen], U)
    marker = np.array([b for _, b in chosen], bool)

    def rows(batches):
        for part in slices(batches, "text"):
            who, what = _known(known, part.column("text"))
            ends = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.record_batch(
                {"doc_id": part.column("doc_id").cast(pa.int64()), "toxic": part.column("toxic"), "at": pa.ListArray.from_arrays(pa.array(ends), pa.array(what))}
            )

    data = taught.select("doc_id", "toxic", "text").mapInArrow(rows, "doc_id long, toxic int, at array<long>").collect()
    toxic = np.array([r.toxic > 0 for r in data])
    who = np.repeat(np.arange(len(data)), [len(r["at"]) for r in data])
    what = np.array([x for r in data for x in r["at"]], np.int64)
    marks = np.bincount(who, marker[what] if len(what) else None, len(data))
    grade = np.where(toxic, 1 + (marks > np.median(marks[toxic])), 0).astype(int)
    weight, cuts = fit_cumulative(who, what, grade, len(known))
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in data])
    return Model(known, weight, cuts, _reject(who, what, grade, len(known), held))


def _reject(who: np.ndarray, what: np.ndarray, grade: np.ndarray, n_features: int, held: np.ndarray) -> float:
    """The least of 0.05, 0.1, .. that takes at most ``LOST`` of the held-out clean documents for toxic, under a model
    fitted on the others."""
    if not (held & (grade == 0)).any() or not (grade[~held] > 0).any() or not (grade[~held] == 0).any():
        return REJECT
    number = np.cumsum(~held) - 1
    own = ~held[who]
    weight, cuts = fit_cumulative(number[who[own]], what[own], grade[~held], n_features)
    score = np.bincount(who, weight[what], len(grade)) if len(who) else np.zeros(len(grade))
    p = 1 / (1 + np.exp(-np.clip(score - cuts[0], -40, 40)))[held & (grade == 0)]
    return next((t for t in np.arange(1, 20) / 20 if (p >= t).mean() <= LOST), 0.95)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` rows as (doc_id, severity, p_toxic, grade, n_features): expected grade, probability of any
    grade above 0, the most probable grade, and how many features of the model the text has. NULL, empty and wordless texts score as texts without any
    feature. Repeated rows are scored one by one; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        known, weight, cuts, _ = held.value
        for part in slices(batches, "text"):
            who, what = _known(known, part.column("text"))
            s = np.bincount(who, weight[what], part.num_rows) if len(who) else np.zeros(part.num_rows)
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))
            mass = np.hstack([np.ones((len(s), 1)), above]) - np.hstack([above, np.zeros((len(s), 1))])
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "severity": pa.array(above.sum(axis=1)),
                    "p_toxic": pa.array(above[:, 0]),
                    "grade": pa.array(mass.argmax(axis=1).astype(np.int32)),
                    "n_features": pa.array(np.bincount(who, minlength=part.num_rows).astype(np.int32)),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, severity double, p_toxic double, grade int, n_features int"
    )


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float | None = None) -> DataFrame:
    """``docs`` without the rows whose text has a probability of ``reject`` (the model's, if not given) or more to
    be toxic; all columns stay as they are. Texts without any feature of the model, NULL and empty ones included, stay."""
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    names = docs.columns

    def run(batches):
        known, weight, cuts, chosen = held.value
        least = chosen if reject is None else reject
        for part in slices(batches, "text"):
            who, what = _known(known, part.column("text"))
            s = np.bincount(who, weight[what], part.num_rows) if len(who) else np.zeros(part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s - cuts[0], -40, 40)))
            known_any = np.bincount(who, minlength=part.num_rows) > 0
            yield part.filter(pa.array((p < least) | ~known_any))

    return docs.select(*names).mapInArrow(run, docs.schema)

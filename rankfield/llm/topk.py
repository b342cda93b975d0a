"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

K = 10
SCALE = 1024
QUERY_BLOCK = 1_024  # queries multiplied at once, at most
TILE = 4_096  # rows of a shard multiplied at once
SHARD_ROWS = 8_192  # rows of a shard, about; a task holds one shard
PARTITIONS = 20_000  # tasks the shards are dealt to, at most
FAN = 64  # partial lists merged into one in a round
_EXACT = 2.0**53


def integers(vectors: DataFrame, id_name: str, vector_name: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * component), the component as double. Rows without id, and vectors that are
    NULL, hold NULL or a non-finite component, are left out."""
    x = F.transform(vector_name, lambda c: c.cast("double"))
    whole = F.forall(vector_name, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return (
        vectors.filter(F.col(id_name).isNotNull() & F.col(vector_name).isNotNull() & F.coalesce(whole, F.lit(False)))
        .select(F.col(id_name).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    )


def _matrices(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each dimension, ids ascending."""
    ids, v = np.asarray(part.column("id")), part.column("v")
    size = np.asarray(v.value_lengths())
    flat = np.asarray(v.flatten())
    start = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[start[rows][:, None] + np.arange(d)]


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``q`` with all rows of ``v``: in floating point where every
    partial sum is exact there, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < _EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def select_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of every row: by score, ties to the smaller id. ``ids`` ascend,
    or ascend within each row where they are a matrix."""
    n, m = score.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    edge = np.partition(score, m - k, axis=1)[:, m - k, None]
    above = score > edge
    room = k - above.sum(axis=1, keepdims=True)
    level = score == edge
    level &= np.cumsum(level, axis=1) <= room
    return np.nonzero(above | level)


def _merged(best: tuple | None, score: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(query row, id, score) of the ``k`` best of every query among ``best`` and a further tile, in order."""
    # Own rows are taken out after the selection, which leaves room for them.
    own = q_ids[:, None] == ids
    r, c = select_best(score, ids, k + int(own.sum(axis=1).max(initial=0)))
    keep = ~own[r, c]
    r, found, s = r[keep], ids[c[keep]], score[r[keep], c[keep]]
    if best is not None:
        r, found, s = (np.concatenate(x) for x in zip(best, (r, found, s)))
    order = np.lexsort((found, -s, r))
    r, found, s = r[order], found[order], s[order]
    within = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q_ids)))[r] < k
    return r[within], found[within], s[within]


def _searcher(k: int, query_block: int):
    """Rows sorted by shard, a shard's vectors (kind 0) ahead of its queries (kind 1): the vectors are
    kept as tiles, the queries pass by in blocks and leave their ``k`` best of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles = None, {}
        for batch in batches:
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            turn = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.concatenate([[0], turn]), np.concatenate([turn, [len(shard)]])):
                if a == b:
                    continue
                if shard[a] != now:
                    now, tiles = shard[a], {}
                step = query_block if kind[a] else TILE
                for begin in range(a, b, step):
                    for ids, v in _matrices(batch.slice(begin, min(step, b - begin))):
                        if not kind[a]:
                            tiles.setdefault(v.shape[1], []).append((ids, v))
                            continue
                        best = None
                        for found, w in tiles.get(v.shape[1], []):
                            best = _merged(best, products(v, w), ids, found, k)
                        if best is not None and len(best[0]):
                            r, found, score = best
                            part = np.full(len(r), now, np.int64)
                            yield pa.record_batch(
                                [pa.array(ids[r]), pa.array(found), pa.array(score), pa.array(part)],
                                names=["query_id", "vec_id", "score", "part"],
                            )

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_name: str = "vec_id",
    vector_name: str = "embedding",
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows of ``vectors`` with the
    largest integer inner products, all where there are fewer; ties go to the smaller id.

    A query's own id is no candidate. Vectors that are NULL, or hold NULL or non-finite components,
    take no part on either side; vectors meet vectors of their own dimension only. Of query rows
    repeating an id the smallest vector asks; candidate rows repeating an id are candidates each.
    Other columns are ignored.

    Vectors are dealt once to shards of about ``shard_rows``, however often an id repeats, and every
    shard gets all queries. A task holds the tiles of one shard while queries pass by in blocks of
    ``query_block``, so neither side has to fit a task, the driver or a broadcast.
    """
    # On disk, so that a row's number, and with it its shard, stays when a task is run again.
    rows = stage(integers(vectors, id_name, vector_name, scale), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    deal = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards))
    held = rows.select(deal.alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = integers(queries, id_name, vector_name, scale).groupBy("id").agg(F.min("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    sent = asked.select(every.alias("shard"), F.lit(1).alias("kind"), "id", "v")
    done = (
        held.unionByName(sent)
        .repartition(min(4 * shards, PARTITIONS), "shard")
        .sortWithinPartitions("shard", "kind", "id")
        .mapInArrow(_searcher(k, query_block), "query_id long, vec_id long, score long, part long")
    )
    parts = shards
    order = (F.desc("score"), F.asc("vec_id"))
    while parts > FAN:
        parts = -(-parts // FAN)
        done = done.withColumn("part", F.pmod("part", F.lit(parts)))
        w = Window.partitionBy("query_id", "part").orderBy(*order)
        done = done.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(*order)
    return (
        done.select("query_id", "vec_id", "score")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

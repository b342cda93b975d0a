"""Permuted labellings and random sets, reproducible from a seed."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import distinct_draws, stream_bases
from ..functions.scalars import attach, with_one_row
from ..session import cut
from .rank import list_sizes, number_rows
from .sets import set_sizes

KINDS = ("no_balance", "balance_class0", "balance_class1", "equalize_and_balance")
# Permutations one task draws at a time.
PERMS_PER_TASK = 64
# Cells of one numpy block.
BLOCK_CELLS = 1 << 21
# Ranks of a block: what one task draws of a permutation, and the scores it holds (2 MB).
RANK_BLOCK = 1 << 18
# Rows that one task makes of a labelling by repeating it for every permutation, about.
ROWS_PER_TASK = 1 << 18
# Rows of a permutation whose keys begin alike, at most about: they are ordered in one window.
BUCKET_ROWS = 1 << 12
# Values of a profile sent to every task, at most; more are joined by shuffle.
BROADCAST_VALUES = 500_000


def shuffle_key(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def _times(df: DataFrame, n: int, first: int = 0) -> DataFrame:
    perms = F.sequence(F.lit(first), F.lit(first + n - 1))
    return df.select(*df.columns, F.explode(perms).alias("perm"))


def _keyed(labels: DataFrame, n: int, first: int, seed: int, bucket_rows: int) -> DataFrame:
    """Rows of every permutation with ``_key``, by which they are ordered, and its first digits, ``_head``: keys are
    hashes, so that rows of one head are few."""
    size = labels.count()
    digits = max(1, math.ceil(math.log(max(size, 1) / bucket_rows, 16)))
    dealt = labels.repartition(max(1, -(-size * n // ROWS_PER_TASK)))
    rows = _times(dealt, n, first).withColumn("_key", shuffle_key(seed, "perm", "sample"))
    return rows.withColumn("_head", F.substring("_key", 1, digits)).withColumn("_key", F.unhex("_key"))


def _heads(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group.., _head, _n, _ahead): rows of each head, and those of the heads before it."""
    before = Window.partitionBy(*group).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_head").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _among_first(rows: DataFrame, group: Sequence[str], sizes: DataFrame, limit: Column) -> DataFrame:
    """Keyed rows with ``_chosen``: whether a row is one of the first ``limit`` of its group. Only rows of the head that
    holds the last of them are ordered; all others are chosen, or not, by their head, where they are."""
    group = list(group)
    rows = rows.dropna(subset=group)
    edges = with_one_row(_heads(rows, group), sizes).withColumn("_limit", limit)
    edges = edges.filter("_ahead < _limit and _limit <= _ahead + _n").select(
        *group, F.col("_head").alias("_edge"), (F.col("_limit") - F.col("_ahead")).alias("_left")
    )
    met = rows.join(F.broadcast(edges), group, "left")  # one edge a group
    at_edge = F.coalesce(F.col("_head") == F.col("_edge"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key", "sample"))
    clear = met.filter(~at_edge).withColumn("_chosen", F.coalesce(F.col("_head") < F.col("_edge"), F.lit(False)))
    tied = met.filter(at_edge).withColumn("_chosen", place <= F.col("_left"))
    return clear.unionByName(tied).select(*rows.columns, "_chosen")


def permute_labels(
    labels: DataFrame,
    n: int,
    seed: int = 149,
    kind: str = "no_balance",
    first: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(perm, sample, class_idx) for ``n`` shuffles of a two-class labelling: the
    samples with the least hashes make up class 0."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    base = labels.select("sample", "class_idx")
    sizes = base.agg(
        F.count(F.when(F.col("class_idx") == 0, 1)).alias("_n0"),
        F.count(F.when(F.col("class_idx") == 1, 1)).alias("_n1"),
    )
    rows = _keyed(base, n, first, seed, bucket_rows)
    new = F.when(F.col("_chosen"), 0).otherwise(1)
    if kind == "no_balance":
        placed = _among_first(rows, ["perm"], sizes, F.col("_n0"))
        return placed.select("perm", "sample", new.alias("class_idx"))
    n0, n1 = F.col("_n0"), F.col("_n1")
    half0, half1 = F.floor(n0 / 2), F.floor(n1 / 2)
    from0 = {
        "balance_class0": half0,
        "balance_class1": n0 - half1,
        "equalize_and_balance": n0 - half0,
    }[kind]
    from1 = n0 - from0
    limit = F.when(F.col("class_idx") == 0, from0).otherwise(from1)
    placed = _among_first(rows, ["perm", "class_idx"], sizes, limit)
    wrong = F.raise_error(F.lit(f"class sizes do not allow {kind}")).cast("int")
    return with_one_row(placed, sizes).select(
        "perm",
        "sample",
        F.when((from0 < 0) | (from0 > n0) | (from1 > n1), wrong).otherwise(new).alias("class_idx"),
    )


def permute_numeric_profile(
    labels: DataFrame,
    n: int,
    seed: int = 149,
    first: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """(perm, sample, num_value): profile values shuffled over the samples. Rows of a permutation are ordered head by head."""
    placed = cut(
        number_rows(
            labels.select("phenotype", "sample", "position", "num_value"),
            [F.col("position").asc(), F.col("sample").asc()],
            ["phenotype"],
            "_at",
        )
    )
    head = ["phenotype", "perm", "_head"]
    rows = _keyed(labels.select("phenotype", "sample"), n, first, seed, bucket_rows).dropna(subset=["phenotype"])
    place = F.row_number().over(Window.partitionBy(*head).orderBy("_key", "sample"))
    ahead = _heads(rows, head[:2]).select(*head, "_ahead")
    shuffled = rows.withColumn("_place", place).join(ahead, head)
    shuffled = shuffled.select("phenotype", "perm", "sample", (F.col("_ahead") + F.col("_place") - 1).alias("_at"))
    values = placed.select("phenotype", "_at", "num_value")
    if placed.count() <= broadcast_values:
        values = F.broadcast(values)
    return shuffled.join(values, ["phenotype", "_at"]).select("perm", "sample", "num_value")


def draw_tasks(
    sets: DataFrame, ranked: DataFrame, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """One row per (list, set, run of permutations), the unit of drawing;
    ``stream`` names the random stream of the set."""
    runs = F.sequence(F.lit(0), F.lit(max(n - 1, 0)), F.lit(PERMS_PER_TASK))
    sizes = attach(set_sizes(sets, by), list_sizes(ranked, by), by)
    if n == 0:
        sizes = sizes.filter(F.lit(False))
    return sizes.select(
        *by,
        "set_name",
        F.concat_ws(":", *[F.col(c).cast("string") for c in by], "set_name").alias("stream"),
        "size",
        "n_features",
        F.explode(runs).alias("perm_from"),
    )


def block_tasks(
    tasks: DataFrame, n: int, seed: int, by: Sequence[str] = (), rank_block: int = RANK_BLOCK
) -> DataFrame:
    """:func:`draw_tasks` split over blocks of ranks: one row per (list, set, run of permutations, block), with how many
    ranks each permutation draws in the block (``counts``) and in the blocks before it (``before``), and the size of
    the block. The counts of a draw without replacement are hypergeometric; with them given, every block is drawn by
    itself, so a set of any size is many tasks."""
    keys = [*by, "set_name"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: [] for c in ("at", "block", "block_size", "counts", "before", "draws")}
            for at, (stream, size, total, start) in enumerate(
                zip(batch["stream"], batch["size"], batch["n_features"], batch["perm_from"])
            ):
                size, total = int(size), int(total)
                perms = range(int(start), min(int(start) + PERMS_PER_TASK, n))
                sizes = np.full(-(-total // rank_block), rank_block)
                sizes[-1] = total - rank_block * (len(sizes) - 1)
                if len(sizes) == 1:
                    counts = np.full((len(perms), 1), size)
                else:
                    counts = np.stack([split_draw(f"{seed}:{stream}:{p}:blocks", sizes, size) for p in perms])
                before = np.cumsum(counts, axis=1) - counts
                for b in np.flatnonzero(counts.any(axis=0)):
                    out["at"].append(at)
                    out["block"].append(int(b))
                    out["block_size"].append(int(sizes[b]))
                    out["counts"].append(np.ascontiguousarray(counts[:, b], np.int64).tobytes())
                    out["before"].append(np.ascontiguousarray(before[:, b], np.int64).tobytes())
                    out["draws"].append(int(counts[:, b].sum()))
            at = out.pop("at")
            kept = batch[[*keys, "stream", "size", "n_features", "perm_from"]].iloc[at].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame(out)], axis=1)

    schema = T.StructType(
        [
            *[tasks.schema[k] for k in (*keys, "stream", "size", "n_features", "perm_from")],
            *[T.StructField(c, T.LongType()) for c in ("block", "block_size")],
            *[T.StructField(c, T.BinaryType()) for c in ("counts", "before")],
            T.StructField("draws", T.LongType()),
        ]
    )
    return tasks.repartition(*keys, "perm_from").mapInPandas(split, schema)


def split_draw(name: str, sizes: np.ndarray, size: int) -> np.ndarray:
    """How many of ``size`` draws without replacement fall into each block; lists of up to 10^9 ranks."""
    digest = hashlib.md5(name.encode()).digest()
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big")))
    return rng.multivariate_hypergeometric(sizes, size, method="marginals")


def runs_of(batch: pd.DataFrame, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the batch, permutation numbers, sorted ranks per permutation within the block, hits before the block)
    of :func:`block_tasks`. A block that is a whole list has one draw per permutation, all of one length."""
    for at, (stream, total, size, start, block, counts, before) in enumerate(
        zip(*(batch[c] for c in ("stream", "n_features", "block_size", "perm_from", "block", "counts", "before")))
    ):
        counts, before = np.frombuffer(counts, np.int64), np.frombuffer(before, np.int64)
        perms = np.arange(int(start), int(start) + len(counts))
        whole = int(size) == int(total)
        step = max(1, BLOCK_CELLS // max(int(counts.max()), 1)) if whole else 1
        for lo in range(0, len(perms), step):
            use = slice(lo, lo + step)
            if counts[lo]:
                tail = "" if whole else f":{block}"
                bases = stream_bases([f"{seed}:{stream}:{p}{tail}" for p in perms[use]])
                yield at, perms[use], distinct_draws(bases, int(counts[lo]), int(size)), before[use]


def random_ranks(
    sets: DataFrame,
    ranked: DataFrame,
    n: int,
    seed: int = 149,
    by: Sequence[str] = (),
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """(by.., set_name, perm, rank): for every set and permutation as many
    distinct ranks as the set has members. Only (set, run, block) rows reach the
    tasks; no list is hashed or sorted as a whole."""
    keys = [*by, "set_name"]
    tasks = block_tasks(draw_tasks(sets, ranked, n, by), n, seed, by, rank_block)
    spread = tasks.repartition(*keys, "perm_from", "block")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, perms, ranks, _ in runs_of(batch, seed):
                out = {k: batch[k].iloc[at] for k in keys}
                out["perm"] = np.repeat(perms, ranks.shape[1]).astype(np.int32)
                out["rank"] = ranks.ravel() + int(batch["block"].iloc[at]) * rank_block
                yield pd.DataFrame(out)

    schema = T.StructType(
        [
            *[tasks.schema[k] for k in keys],
            T.StructField("perm", T.IntegerType()),
            T.StructField("rank", T.LongType()),
        ]
    )
    return spread.mapInPandas(emit, schema)


def random_sets(
    ranked: DataFrame, sets: DataFrame, n: int, seed: int = 149, rank_block: int = RANK_BLOCK
) -> DataFrame:
    """(set_name, perm, member): random sets of the sizes of ``sets``."""
    return random_ranks(sets, ranked, n, seed, rank_block=rank_block).join(
        ranked.select("rank", F.col("feature").alias("member")), "rank"
    ).select("set_name", "perm", "member")

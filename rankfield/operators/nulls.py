"""Null distributions of the enrichment score.

Each null exists as a relational plan, the definition, and as array work in tasks
of bounded size: random sets here, permuted labels in :mod:`.label_null`. Both
take lists, sets and matrices of any size the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import POWER_GUARD, TIE_SCALE
from ..functions.scalars import attach
from ..session import cut
from .enrich import hits, pick_extreme, score_hits
from .label_null import null_by_labels, scores_by_labels, weigh
from .metrics import CLASS_METRICS, score_features
from .permute import (
    RANK_BLOCK,
    block_tasks,
    draw_tasks,
    permute_labels,
    permute_numeric_profile,
    random_ranks,
    runs_of,
)
from .rank import attach_sizes, list_sizes, rank_features
from .sets import set_sizes

__all__ = ["null_by_labels", "null_by_labels_plan", "null_by_sets", "null_by_sets_of_lists", "null_by_sets_plan", "null_of_lists"]

SPREAD_METRICS = ("signal_to_noise", "t_test")
# Draws of one group of a block's tasks.
DRAWS_PER_GROUP = 1_000_000


# ---- random sets -----------------------------------------------------------


def null_by_sets_plan(
    ranked: DataFrame,
    sets: DataFrame,
    n: int,
    seed: int = 149,
    scheme: str = "weighted",
    by: Sequence[str] = (),
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """(by.., set_name, perm, es): drawn ranks joined to the list, then the same
    windows as the real score."""
    by = list(by)
    drawn = random_ranks(sets, ranked, n, seed, by, rank_block)
    scores = ranked.select(*by, "rank", "score")
    perms = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("perm")
    sizes = list_sizes(ranked, by).select(*by, "n_features", perms)
    scored = score_hits(drawn.join(scores, [*by, "rank"]), sizes, scheme, [*by, "perm"])
    return pick_extreme(scored, scheme, [*by, "perm"]).select(*by, "set_name", "perm", "es")


def extreme_of_rows(
    ranks: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray], total: int
) -> np.ndarray:
    """ES of each row of sorted hit ranks."""
    share, hit, fixed = weights
    n = ranks.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = hit[ranks] / share[ranks].sum(axis=1, keepdims=True) + fixed[ranks] * POWER_GUARD
    step = 1.0 / (total - n) if total > n else 0.0
    reached = np.cumsum(w, axis=1)
    missed = (ranks - np.arange(n)) * step
    points = np.empty((len(ranks), 2 * n + 1))
    points[:, 0 : 2 * n : 2] = reached - w - missed
    points[:, 1 : 2 * n : 2] = reached - missed
    points[:, -1] = reached[:, -1] - (total - n) * step
    best = np.argmax(np.floor(np.abs(points) * TIE_SCALE + 0.5), axis=1)
    return points[np.arange(len(ranks)), best]


def null_by_sets(
    ranked: DataFrame,
    sets: DataFrame,
    n: int,
    seed: int = 149,
    scheme: str = "weighted",
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """(set_name, perm, es) of random sets on the given list; same draws and
    values as :func:`null_by_sets_plan`."""
    return null_by_sets_of_lists(ranked, sets, n, (), seed, scheme, rank_block)


def _list_blocks(ranked: DataFrame, by: list[str], rank_block: int) -> DataFrame:
    """(by.., block, scores): the scores of a block of ranks, in order."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = {k: [rows[k].iloc[0]] for k in (*by, "block")}
        return pd.DataFrame(out | {"scores": [rows.sort_values("rank")["score"].to_numpy(float).tobytes()]})

    rows = ranked.select(
        *by, F.floor(F.col("rank") / rank_block).alias("block"), "rank", F.col("score").cast("double").alias("score")
    )
    schema = T.StructType([*[rows.schema[k] for k in (*by, "block")], T.StructField("scores", T.BinaryType())])
    return rows.groupBy(*by, "block").applyInPandas(pack, schema)


def _groups_of_blocks(sets: DataFrame, ranked: DataFrame, n: int, by: list[str], rank_block: int) -> DataFrame:
    """(by.., block, _groups): in how many groups the draws of a block of ranks, as many as can be expected there, are
    made."""
    wanted = attach(set_sizes(sets, by).groupBy(*by).agg(F.sum("size").alias("_wanted")), list_sizes(ranked, by), by)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_features") - 1) / rank_block))).alias("block")
    drawn = F.col("_wanted") * n * F.least(F.lit(1.0), rank_block / F.col("n_features"))
    groups = F.greatest(F.lit(1).cast("long"), F.ceil(drawn / DRAWS_PER_GROUP))
    return wanted.filter("_wanted IS NOT NULL").select(*by, blocks, groups.alias("_groups"))


def null_by_sets_of_lists(
    ranked: DataFrame,
    sets: DataFrame,
    n: int,
    by: Sequence[str],
    seed: int = 149,
    scheme: str = "weighted",
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """(by.., set_name, perm, es) for many lists in one job.

    Draws are split over blocks of ranks, and the tasks of a block meet its scores
    in as many groups as its draws call for: neither a heavy list nor a large set
    is one task, and no list travels through the driver. Lists of one block are
    done there. On longer ones every block first reports its hits and weights;
    with the sums of the blocks before it, it then finds its own extreme, and the
    greatest of a draw's blocks is the score. ``sets`` carries the ``by`` columns."""
    by = list(by)
    key = [*by, "set_name"]
    tasks = block_tasks(draw_tasks(sets, ranked, n, by), n, seed, by, rank_block)
    work = _groups_of_blocks(sets, ranked, n, by, rank_block)
    group = F.pmod(F.xxhash64("stream", "perm_from"), F.col("_groups")).alias("_group")
    dealt = tasks.join(work, [*by, "block"]).select(*tasks.columns, group)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))
    meet = [*by, "block", "_group"]
    lists = _list_blocks(ranked, by, rank_block).join(
        work.select(*by, "block", numbers.alias("_group")), [*by, "block"]
    )
    # the two sides share ancestors: fresh names keep their keys apart
    lists = lists.select(*[F.col(k).alias(f"_right_{k}") for k in meet], "scores")

    def with_scores(rows: DataFrame, work_of, columns: dict[str, T.DataType]) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(left) and len(right):
                weights = weigh(np.frombuffer(right["scores"].iloc[0], float), scheme)
                parts = list(work_of(left, weights))
            return pd.concat(parts) if parts else pd.DataFrame(columns=schema.names)

        schema = T.StructType(
            [*[tasks.schema[k] for k in key], *[T.StructField(c, t) for c, t in columns.items()]]
        )
        left = rows.groupBy(*meet)
        return left.cogroup(lists.groupBy(*[f"_right_{k}" for k in meet])).applyInPandas(run, schema)

    def named(left: pd.DataFrame, at: int, perms: np.ndarray) -> dict:
        return {k: left[k].iloc[at] for k in key} | {"perm": perms.astype(np.int32)}

    def score(left: pd.DataFrame, weights) -> Iterator[pd.DataFrame]:
        for at, perms, ranks, _ in runs_of(left, seed):
            total = int(left["n_features"].iloc[at])
            yield pd.DataFrame(named(left, at, perms) | {"es": extreme_of_rows(ranks, weights, total)})

    whole = F.col("block_size") == F.col("n_features")
    out = with_scores(dealt.filter(whole), score, {"perm": T.IntegerType(), "es": T.DoubleType()})
    if list_sizes(ranked, by).filter(F.col("n_features") > rank_block).isEmpty():
        return out

    def report(left: pd.DataFrame, weights) -> Iterator[pd.DataFrame]:
        for at, perms, ranks, _ in runs_of(left, seed):
            sums = {c: w[ranks].sum(axis=1) for c, w in zip(("_share", "_hit", "_fixed"), weights)}
            yield pd.DataFrame(
                named(left, at, perms) | {"perm_from": left["perm_from"].iloc[at], "block": left["block"].iloc[at]} | sums
            )

    split = dealt.filter(~whole)
    number, double = T.LongType(), T.DoubleType()
    sums = with_scores(
        split,
        report,
        {"perm": T.IntegerType(), "perm_from": tasks.schema["perm_from"].dataType, "block": number, "_share": double, "_hit": double, "_fixed": double},
    )
    draw = Window.partitionBy(*key, "perm")
    ahead = draw.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *key,
        "perm_from",
        "block",
        F.struct(
            "perm",
            F.sum("_share").over(draw).alias("share"),
            F.coalesce(F.sum("_hit").over(ahead), F.lit(0.0)).alias("hit"),
            F.coalesce(F.sum("_fixed").over(ahead), F.lit(0.0)).alias("fixed"),
        ).alias("sums"),
    )
    unit = [*key, "perm_from", "block"]
    told = split.join(sums.groupBy(*unit).agg(F.collect_list("sums").alias("sums")), unit)

    def extreme(left: pd.DataFrame, weights) -> Iterator[pd.DataFrame]:
        _, hit, fixed = weights
        known = [{int(s["perm"]): s for s in row} for row in left["sums"]]
        for at, perms, ranks, before in runs_of(left, seed):
            for perm, hits, earlier in zip(perms, ranks, before):
                s, n_hits = known[at][int(perm)], int(left["size"].iloc[at])
                total, low = int(left["n_features"].iloc[at]), int(left["block"].iloc[at]) * rank_block
                with np.errstate(divide="ignore", invalid="ignore"):
                    w = hit[hits] / s["share"] + fixed[hits] * POWER_GUARD
                    reached = s["hit"] / s["share"] + s["fixed"] * POWER_GUARD + np.cumsum(w)
                step = 1.0 / (total - n_hits) if total > n_hits else 0.0
                missed = (hits + low - earlier - np.arange(len(hits))) * step
                points = np.empty(2 * len(hits))
                points[0::2], points[1::2] = reached - w - missed, reached - missed
                level = np.floor(np.abs(points) * TIE_SCALE + 0.5)
                best = int(np.argmax(level))
                last = reached[-1] - (total - n_hits) * step if earlier + len(hits) == n_hits else np.nan
                yield pd.DataFrame(
                    named(left, at, np.array([perm]))
                    | {"block": [low // rank_block], "es": [points[best]], "level": [level[best]], "last": [last]}
                )

    found = with_scores(told, extreme, {"perm": T.IntegerType(), "block": number, "es": double, "level": double, "last": double})
    best = found.groupBy(*key, "perm").agg(
        F.max_by("es", F.struct("level", -F.col("block"))).alias("es"), F.max("level").alias("level"),
        F.min(F.when(~F.isnan("last"), F.col("last"))).alias("last"),
    )
    further = F.floor(F.abs("last") * TIE_SCALE + 0.5) > F.col("level")
    best = best.select(*key, "perm", F.when(further, F.col("last")).otherwise(F.col("es")).alias("es"))
    return out.unionByName(best)


# ---- permuted labels -------------------------------------------------------


def permuted_scores(
    features: DataFrame,
    labels: DataFrame,
    n: int,
    seed: int = 149,
    metric: str = "signal_to_noise",
    kind: str = "no_balance",
    **options,
) -> DataFrame:
    """(perm, feature, row_idx, score). Metrics of class means and spreads come from tiles, which do not copy the cells for
    every permutation; all others with joins and aggregates only, as :func:`permuted_scores_plan`."""
    if metric in SPREAD_METRICS and options.get("fix_low", True) and not options.get("median"):
        return scores_by_labels(features, labels, n, seed, metric, kind, repeats=True, **options)
    return permuted_scores_plan(features, labels, n, seed, metric, kind, **options)


def permuted_scores_plan(
    features: DataFrame,
    labels: DataFrame,
    n: int,
    seed: int = 149,
    metric: str = "signal_to_noise",
    kind: str = "no_balance",
    **options,
) -> DataFrame:
    """:func:`permuted_scores` with joins and aggregates only: cells times permutations."""
    if metric in CLASS_METRICS:
        shuffled = permute_labels(labels, n, seed, kind)
    else:
        shuffled = permute_numeric_profile(labels, n, seed)
    return score_features(metric, features, shuffled, by=["perm"], **options)


def permuted_lists(
    scores: DataFrame, mode: str = "real", ascending: bool = False, ends: int | None = None
) -> DataFrame:
    """Rank the scores of every permutation. With ``ends`` only the first and last ``ends`` of each list are kept, at
    their ranks in the whole list; ``scores`` may then be what scoring left of it, with its ``n_features``."""
    if ends is None:
        return rank_features(scores, mode=mode, ascending=ascending, by=["perm"])
    if "n_features" not in scores.columns:
        scores = attach_sizes(scores, scores, ["perm"])
    value = F.col("score") if mode == "real" else F.abs("score")
    ties = [F.col("row_idx"), F.col("feature")]
    first = [value.asc_nulls_first() if ascending else value.desc_nulls_last(), *[t.asc() for t in ties]]
    last = [value.desc_nulls_last() if ascending else value.asc_nulls_first(), *[t.desc() for t in ties]]
    of_list = Window.partitionBy("perm")

    def near(order) -> DataFrame:
        return scores.withColumn("_place", F.row_number().over(of_list.orderBy(*order)).cast("long")).filter(F.col("_place") <= ends)

    head = near(first).withColumn("rank", F.col("_place") - 1)
    tail = near(last).withColumn("rank", F.col("n_features") - F.col("_place")).filter(F.col("rank") >= ends)
    return cut(head.unionByName(tail).drop("_place"))  # few rows of many; its users look at them from both ends


def null_by_labels_plan(
    features: DataFrame,
    labels: DataFrame,
    sets: DataFrame,
    n: int,
    seed: int = 149,
    metric: str = "signal_to_noise",
    scheme: str = "weighted",
    kind: str = "no_balance",
    mode: str = "real",
    ascending: bool = False,
    **options,
) -> DataFrame:
    scores = permuted_scores(features, labels, n, seed, metric, kind, **options)
    return null_of_lists(permuted_lists(scores, mode, ascending), sets, scheme)


def null_of_lists(lists: DataFrame, sets: DataFrame, scheme: str = "weighted") -> DataFrame:
    scored = hits(lists, sets, scheme, ["perm"])
    return pick_extreme(scored, scheme, ["perm"]).select("set_name", "perm", "es")

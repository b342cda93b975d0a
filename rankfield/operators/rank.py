"""Ranking without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.scalars import attach
from ..session import cut

_POSITION_BITS = 33
BROADCAST_OFFSETS = 200_000  # (group, task) offsets sent to every task, at most


def _placed(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted by (by, order), with the number of
    their task and their position in it.

    One range shuffle spreads any single group, and any run of equal leading
    sort keys, over all tasks. The placed rows are checkpointed, so that a lost
    executor cannot lead to other range bounds."""
    keys = [F.col(c) for c in by]
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return (
        cut(placed)
        .withColumn("_task", F.shiftright("_at", _POSITION_BITS))
        .withColumn("_pos", F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1))
    )


def _earlier_tasks(by: Sequence[str]):
    """Window over per-task totals: at most one row per (group, task)."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1
    )


def beside(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Offsets to be joined to the placed rows: sent to them, so that these stay
    in their tasks, where they are few; without groups there is one a task."""
    if not by:
        return F.broadcast(tasks)
    tasks = cut(tasks)
    return F.broadcast(tasks) if tasks.count() <= BROADCAST_OFFSETS else tasks


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in order, with their number within the task's rows of their group
    (``_in``) and whether it is the task's first group (``_head``)."""
    last, groups, rows = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        low, high = np.asarray(batch.column("_low")), np.asarray(batch.column("_high"))
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        new[0] = (low[0], high[0]) != last
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -rows))
        number, group = at - start, groups + np.cumsum(new)
        last, groups, rows = (low[-1], high[-1]), int(group[-1]), int(number[-1]) + 1
        out = pa.Table.from_batches([batch]).append_column("_in", pa.array(number, pa.int64()))
        yield from out.append_column("_head", pa.array(group == 1)).to_batches()


def _number_in_place(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Placed rows with ``_no`` within their group, for any number of groups, without a
    further shuffle: a task's rows of a group are a stretch, counted where it is, and only
    the first stretch of a task may go on from tasks before, so there is an offset a task.

    Neighbouring stretches are told apart by 128 bits of hash."""
    keys = [F.col(c) for c in by]
    keyed = placed.withColumn("_low", F.xxhash64(*keys)).withColumn("_high", F.xxhash64(F.lit(1), *keys))
    key = F.struct("_low", "_high")
    edges = cut(
        keyed.groupBy("_task").agg(
            F.min_by(key, "_pos").alias("_first"), F.max_by(key, "_pos").alias("_last")
        )
    )
    ends = (
        keyed.join(F.broadcast(edges), "_task")
        .filter(key == F.col("_last"))
        .groupBy("_task", F.col("_last").alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy("_key").orderBy("_task").rangeBetween(Window.unboundedPreceding, -1)
    shifts = (
        ends.withColumn("_asks", F.lit(False))
        .unionByName(
            edges.select(
                "_task",
                F.col("_first").alias("_key"),
                F.lit(0).cast("long").alias("_n"),
                F.lit(True).alias("_asks"),
            )
        )
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_asks")
        .select("_task", "_shift")
    )
    schema = StructType([*keyed.schema.fields, StructField("_in", LongType()), StructField("_head", BooleanType())])
    return (
        keyed.mapInArrow(_counted, schema)
        .join(F.broadcast(shifts), "_task")
        .withColumn("_no", F.col("_in") + F.when(F.col("_head"), F.col("_shift")).otherwise(0))
    )


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
    start: int = 0,
) -> DataFrame:
    """Consecutive numbers in ``order`` within each ``by`` group: the position
    inside a task plus the counts of the tasks before it. ``order`` should end
    in a unique column. Rows without a group have no number and are left out. The
    rows are shuffled once, into their order."""
    by = list(by)
    placed = _placed(df, order, by)
    tasks = placed.groupBy(*by, "_task").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = F.coalesce(F.sum("_n").over(_earlier_tasks(by)), F.lit(0))
    tasks = tasks.select(*by, "_task", (before - F.col("_first")).alias("_shift"))
    kept = [c for c in df.columns if c != name]
    if by:
        tasks = cut(tasks)
        if tasks.count() > BROADCAST_OFFSETS:
            numbered = _number_in_place(placed.dropna(subset=by), by)
            return numbered.select(*kept, (F.col("_no") + start).cast("long").alias(name))
    return placed.join(F.broadcast(tasks), [*by, "_task"]).select(
        *[placed[c] for c in kept],
        (F.col("_pos") + F.col("_shift") + start).cast("long").alias(name),
    )


def running_total(
    df: DataFrame, order: Sequence[Column], by: Sequence[str], amount: str, name: str
) -> DataFrame:
    """Inclusive running sum of ``amount`` in ``order`` within ``by``; rows are
    summed inside their task, task totals across."""
    by = list(by)
    placed = _placed(df, order, by)
    tasks = placed.groupBy(*by, "_task").agg(F.sum(amount).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(_earlier_tasks(by)), F.lit(0))
    tasks = beside(tasks.select(*by, "_task", before.alias("_before")), by)
    inside = Window.partitionBy(*by, "_task").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        placed.withColumn("_inside", F.sum(amount).over(inside))
        .join(tasks, [*by, "_task"])
        .select(
            *[F.col(c) for c in df.columns if c != name],
            (F.col("_inside") + F.col("_before")).alias(name),
        )
    )


def score_order(
    mode: str = "real", ascending: bool = False, tie: Sequence[str] = ("row_idx",)
) -> list[Column]:
    """Sort keys: missing scores count as least, ties keep input order."""
    value = F.col("score") if mode == "real" else F.abs(F.col("score"))
    first = value.asc_nulls_first() if ascending else value.desc_nulls_last()
    return [first, *[F.col(t).asc() for t in tie]]


def rank_features(
    scores: DataFrame,
    *,
    mode: str = "real",
    ascending: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """(feature, row_idx, score) -> the same with a 0-based ``rank``."""
    return number_rows(scores, score_order(mode, ascending), by)


def rank_scores(
    scores: DataFrame,
    *,
    mode: str = "real",
    ascending: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rank a given score vector; ties keep ``row_idx`` order, or feature order
    where the input has no ``row_idx``."""
    tie = "row_idx" if "row_idx" in scores.columns else "feature"
    return number_rows(scores, score_order(mode, ascending, [tie]), by)


def rerank(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Close the gaps in ``rank``, order kept."""
    return number_rows(ranked, [F.col("rank").asc()], by)


def sub_ranking(
    ranked: DataFrame, members: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    keep = members.select(F.col("member").alias("feature")).distinct()
    return rerank(ranked.join(keep, "feature", "left_semi"), by)


def list_sizes(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_features"))


def attach_sizes(df: DataFrame, ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``n_features`` of the row's ranked list."""
    return attach(df, list_sizes(ranked, by), by)


def top_bottom_k(ranked: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """First and last ``k`` features; ``side`` is ``top`` or ``bottom``,
    ``position`` counts from 1 at the respective end. Lists that hold ``n_features``
    may be their ends only."""
    sized = ranked if "n_features" in ranked.columns else attach_sizes(ranked, ranked, by)
    top = sized.filter(F.col("rank") < k).select(
        *ranked.columns, F.lit("top").alias("side"), (F.col("rank") + 1).alias("position")
    )
    bottom = sized.filter(F.col("rank") >= F.col("n_features") - k).select(
        *ranked.columns,
        F.lit("bottom").alias("side"),
        (F.col("n_features") - F.col("rank")).alias("position"),
    )
    return top.unionByName(bottom)


def zero_crossing_rank(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1-based rank of the first score that is not above zero."""
    return ranked.groupBy(*by).agg(
        F.min(F.when(F.col("score") <= 0, F.col("rank") + 1)).alias("zero_crossing_rank")
    )


def sort_results_by_nes(results: DataFrame, ascending: bool = False) -> DataFrame:
    """Add ``position``, the 0-based place by NES; a missing NES is least."""
    nes = F.col("nes")
    first = nes.asc_nulls_first() if ascending else nes.desc_nulls_last()
    return number_rows(results, [first, F.col("set_name").asc()], name="position")

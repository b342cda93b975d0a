"""Leading edge: the members that carry the score of a set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_leading_edge() -> Column:
    pos = F.col("es") >= 0
    return F.when(pos, F.col("rank") <= F.col("rank_at_max")).otherwise(
        F.col("rank") >= F.col("rank_at_max")
    )


def leading_edge_members(
    scored_hits: DataFrame, es: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    key = [*by, "set_name"]
    return (
        scored_hits.join(es.select(*key, "es", "rank_at_max"), key)
        .filter(in_leading_edge())
        .select(*key, "feature", "rank", "score")
    )


def peak_rank() -> Column:
    """Ranks from the list end the score points to."""
    return F.when(F.col("es") >= 0, F.col("rank_at_max")).otherwise(
        F.col("n_features") - F.col("rank_at_max")
    )


def leading_edge_stats(
    scored_hits: DataFrame, es: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Fractions of set and list before the peak, and their signal strength."""
    key = [*by, "set_name"]
    counted = (
        scored_hits.join(es.select(*key, "es", "rank_at_max"), key)
        .groupBy(*key)
        .agg(
            F.count(F.when(in_leading_edge(), 1)).alias("n_edge"),
            F.max("n_hits").alias("size"),
            F.max("n_features").alias("n_features"),
            F.max("es").alias("es"),
            F.max("rank_at_max").alias("rank_at_max"),
        )
        .withColumn("peak_rank", peak_rank())
    )
    n, size = F.col("n_features"), F.col("size")
    tag = F.try_divide(F.col("n_edge"), size)
    listed = F.try_divide(F.col("peak_rank"), n)
    signal = F.try_divide(
        F.try_divide(F.col("tag_fraction"), 1 - F.col("list_fraction")),
        F.try_divide(n, n - size),
    )
    return (
        counted.withColumn("tag_fraction", tag)
        .withColumn("list_fraction", listed)
        .withColumn("signal_strength", signal)
        .select(*key, "n_edge", "peak_rank", "tag_fraction", "list_fraction", "signal_strength")
    )

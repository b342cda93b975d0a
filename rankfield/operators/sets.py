"""Collections of named sets: (set_name, member[, member_pos, description])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MIN = 15
DEFAULT_MAX = 500
REJECTED = "Rejected!"


def set_sizes(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sets.groupBy(*by, "set_name").agg(F.count(F.lit(1)).alias("size"))


def restrict(sets: DataFrame, features: DataFrame) -> DataFrame:
    """Members present among ``features`` (feature)."""
    present = features.select(F.col("feature").alias("member")).distinct()
    return sets.join(present, "member", "left_semi").select(sets.columns)


def filter_sets_by_size(
    sets: DataFrame,
    ranked: DataFrame,
    min_size: int = DEFAULT_MIN,
    max_size: int = DEFAULT_MAX,
) -> DataFrame:
    """Raw size >= min, then restrict to the list, then min <= size <= max.

    ``min_size == max_size`` switches the whole step off. Sizes are counted with
    map-side aggregation; only set names and counts meet the members again."""
    if min_size == max_size:
        return sets
    large = set_sizes(sets).filter(F.col("size") >= min_size).select("set_name")
    inside = restrict(sets.join(large, "set_name", "left_semi"), ranked)
    kept = (
        set_sizes(inside)
        .filter((F.col("size") >= min_size) & (F.col("size") <= max_size) & (F.col("size") > 0))
        .select("set_name")
    )
    return inside.join(kept, "set_name", "left_semi").select(sets.columns)


def filter_sets_by_list(
    sets: DataFrame,
    ranked: DataFrame,
    by: Sequence[str],
    min_size: int = DEFAULT_MIN,
    max_size: int = DEFAULT_MAX,
) -> DataFrame:
    """The size filter for many lists at once: (by.., set_name, member)."""
    inside = ranked.select(*by, F.col("feature").alias("member")).join(
        sets.select("set_name", "member"), "member"
    )
    if min_size == max_size:
        # whole sets, as for one list; a set without any hit in a list has no score there
        met = inside.select(*by, "set_name").distinct()
        return met.join(sets.select("set_name", "member"), "set_name").select(
            *by, "set_name", "member"
        )
    large = set_sizes(sets).filter(F.col("size") >= min_size).select("set_name")
    inside = inside.join(large, "set_name", "left_semi")
    kept = (
        inside.groupBy(*by, "set_name")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") >= min_size) & (F.col("_n") <= max_size))
        .select(*by, "set_name")
    )
    return inside.join(kept, [*by, "set_name"], "left_semi").select(*by, "set_name", "member")


def require_sets(sets: DataFrame) -> DataFrame:
    """Fail where the size filter left nothing."""
    if sets.isEmpty():
        raise ValueError("no set is left after the size filters")
    return sets


def set_size_report(sets: DataFrame, kept: DataFrame) -> DataFrame:
    after = set_sizes(kept).withColumnRenamed("size", "restricted_size")
    return (
        set_sizes(sets)
        .withColumnRenamed("size", "original_size")
        .join(after, "set_name", "left")
        .withColumn("status", F.when(F.col("restricted_size").isNull(), REJECTED).otherwise(""))
    )


def membership_index(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """(feature, set_name) for features of the list that are in some set."""
    return ranked.select("feature").join(
        sets.select("set_name", F.col("member").alias("feature")), "feature"
    )


def count_members(sets: DataFrame, features: DataFrame) -> DataFrame:
    """Members of every set that are present; sets without any count 0."""
    found = set_sizes(restrict(sets, features)).withColumnRenamed("size", "n_present")
    return (
        set_sizes(sets)
        .join(found, "set_name", "left")
        .select("set_name", "size", F.coalesce("n_present", F.lit(0)).alias("n_present"))
    )

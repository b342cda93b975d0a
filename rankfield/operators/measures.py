"""Statistic primitives over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_negative, stddev_floor, tie_key, variance
from ..functions.scalars import with_one_row
from .rank import attach_sizes
from .select import group_median


def variances(features: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    return features.groupBy(*by).agg(
        variance("value", biased=True).alias("var_biased"),
        variance("value").alias("var_unbiased"),
    )


def floored_stddev(
    features: DataFrame, by: Sequence[str] = ("feature",), biased: bool = False
) -> DataFrame:
    return (
        features.groupBy(*by)
        .agg(F.avg("value").alias("mean"), F.sqrt(variance("value", biased)).alias("sd"))
        .withColumn("sd_floor", stddev_floor("sd", "mean"))
    )


def missing_safe_stat(features: DataFrame, stat: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by.., value): mean, median, sum or max of the values that are there."""
    if stat == "median":
        return group_median(features, by, "value", "value")
    ways = {"mean": F.avg, "sum": F.sum, "max": F.max}
    return features.groupBy(*by).agg(ways[stat]("value").alias("value"))


def missing_safe_stats(features: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    others = features.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.max("value").alias("max")
    )
    return others.join(group_median(features, by, "value", "median"), list(by))


def max_deviation(df: DataFrame, column: str, index: str, by: Sequence[str]) -> DataFrame:
    """Signed extreme furthest from zero and its index; a tie between the two
    sides goes to the positive one, among equal values the first index wins."""
    v, i = F.col(column), F.col(index)
    return df.filter(v.isNotNull()).groupBy(*by).agg(
        F.max_by(
            F.struct(v.alias("v"), i.alias("i")),
            F.struct(tie_key(v), F.signum(v), -i),
        ).alias("_best")
    ).select(*by, F.col("_best.v").alias("max_dev"), F.col("_best.i").alias("max_dev_index"))


def range_mean(ranked: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean score in ``bins`` equal index ranges of each list."""
    sized = attach_sizes(ranked, ranked, by)
    # rank r is in bin b when int(b*N/bins) <= r < int((b+1)*N/bins)
    n = F.col("n_features")
    b = F.floor(((F.col("rank") + 1) * bins - 1) / n)
    return (
        sized.withColumn("bin", b)
        .groupBy(*by, "bin")
        .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    )


def metric_weights(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and weights per sign of a list; zero counts as negative."""
    neg = is_negative("score")
    sums = ranked.groupBy(*by).agg(
        F.count(F.when(~neg, 1)).alias("n_pos"),
        F.count(F.when(neg, 1)).alias("n_neg"),
        F.coalesce(F.sum(F.when(~neg, F.col("score"))), F.lit(0.0)).alias("weight_pos"),
        F.coalesce(F.sum(F.when(neg, F.col("score"))), F.lit(0.0)).alias("weight_neg"),
    )
    total = F.col("weight_pos") + F.abs("weight_neg")
    size = F.col("n_pos") + F.col("n_neg")
    return (
        sums.withColumn("frac_pos", F.try_divide(F.col("n_pos"), size))
        .withColumn("frac_neg", F.try_divide(F.col("n_neg"), size))
        .withColumn("weight_frac_pos", F.try_divide(F.col("weight_pos"), total))
        .withColumn("weight_frac_neg", F.abs(F.try_divide(F.col("weight_neg"), total)))
    )


def row_scale_stats(
    features: DataFrame, buckets: int = 12, median: bool = False
) -> DataFrame:
    """Relative place of each cell in its row: 0..0.5 up to the row's centre,
    0.5..1 above it, then cut into ``buckets``."""
    rows = features.groupBy("feature").agg(
        F.min("value").alias("row_min"),
        F.max("value").alias("row_max"),
        F.avg("value").alias("row_centre"),
    )
    if median:
        rows = rows.drop("row_centre").join(
            group_median(features, ["feature"], "value", "row_centre"), "feature"
        )
    v, lo, hi, mid = (F.col(c) for c in ("value", "row_min", "row_max", "row_centre"))
    place = F.when(v <= mid, F.try_divide(0.5 * (v - lo), mid - lo)).otherwise(
        0.5 + F.try_divide(0.5 * (v - mid), hi - mid)
    )
    joined = features.filter(v.isNotNull()).join(rows, "feature")
    return joined.withColumn("place", F.coalesce(place, F.lit(0.0))).withColumn(
        "bucket", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1))
    ).select("feature", "sample", "value", "row_min", "row_max", "row_centre", "place", "bucket")


def matrix_scale_stats(features: DataFrame) -> DataFrame:
    return features.agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def matrix_scale_edges(features: DataFrame, slots: int = 12, log: bool = False) -> DataFrame:
    """Upper bucket edges over the whole matrix: even steps min..mean and
    mean..max, or even steps of the logarithm above the minimum."""
    ladder = features.sparkSession.range(1, slots + 1).withColumnRenamed("id", "slot")
    s = F.col("slot")
    lo, hi, mid = F.col("min"), F.col("max"), F.col("mean")
    if log:
        edge = F.exp(s * F.ln(hi - lo + 1) / slots) + lo - 1
    else:
        half = slots // 2
        edge = F.when(s <= half, lo + s * (mid - lo) / half).otherwise(
            mid + (s - half) * (hi - mid) / (slots - half)
        )
    return with_one_row(ladder, matrix_scale_stats(features)).select("slot", edge.alias("edge"))


def equal_bin_histogram(
    df: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in equal bins between the least and the greatest value."""
    known = df.filter(F.col(column).isNotNull())
    ends = known.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    joined = known.join(ends, list(by)) if by else with_one_row(known, ends)
    v, lo, hi = F.col(column), F.col("lo"), F.col("hi")
    b = F.coalesce(
        F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(bins - 1)), F.lit(0)
    )
    return (
        joined.withColumn("bin", b.cast("long"))
        .groupBy(*by, "bin")
        .agg(
            F.min(lo + F.col("bin") * (hi - lo) / bins).alias("bin_start"),
            F.count(F.lit(1)).alias("n"),
        )
    )

"""Feature scoring metrics as one aggregation per feature.

Class metrics score class 0 (the class of interest) against class 1. A feature
without a value in one class scores 0.0. Distances rank descending like scores,
so the least similar feature comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import stddev_floor, variance
from .select import group_median


def class_stats(
    features: DataFrame,
    labels: DataFrame,
    *,
    median: bool = False,
    fix_low: bool = True,
    biased: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, centre, variance and floored sd of each class, one row per feature.

    ``labels`` is joined on sample; where it carries ``by`` columns (a
    permutation number) these become part of the key."""
    joined = features.filter(F.col("value").isNotNull()).join(
        labels.select(*by, "sample", "class_idx"), "sample"
    )
    aggs = []
    for i in (0, 1):
        v = F.when(F.col("class_idx") == i, F.col("value"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            variance(v, biased).alias(f"var{i}"),
        ]
    key = [*by, "feature", "row_idx"]
    out = joined.groupBy(*key).agg(*aggs)
    if median:
        both = group_median(joined.filter("class_idx in (0, 1)"), [*key, "class_idx"], "value", "_median")
        sides = [F.max(F.when(F.col("class_idx") == i, F.col("_median"))).alias(f"median{i}") for i in (0, 1)]
        out = out.join(both.groupBy(*key).agg(*sides), key, "left")
    for i in (0, 1):
        out = out.withColumn(f"centre{i}", F.col(f"median{i}" if median else f"mean{i}"))
        out = out.withColumn(
            f"sd{i}", stddev_floor(F.sqrt(f"var{i}"), F.col(f"mean{i}"), fix_low)
        )
    return out


def _signal_to_noise(biased: bool) -> Column:
    return F.try_divide(
        F.col("centre0") - F.col("centre1"), F.col("sd0") + F.col("sd1")
    )


def _t_test(biased: bool) -> Column:
    less = 1 if biased else 0
    parts = [
        F.try_divide(F.col(f"sd{i}") * F.col(f"sd{i}"), F.col(f"n{i}") - less) for i in (0, 1)
    ]
    score = F.try_divide(F.col("centre0") - F.col("centre1"), F.sqrt(parts[0] + parts[1]))
    # a class of one value has an infinite biased spread, so the score is 0
    return F.when(F.least("n0", "n1") <= less, F.lit(0.0)).otherwise(score)


def _ratio(biased: bool = False) -> Column:
    return F.try_divide(F.col("centre0"), F.col("centre1"))


def _diff(biased: bool = False) -> Column:
    return F.col("centre0") - F.col("centre1")


def _log2_ratio(biased: bool = False) -> Column:
    return F.log2(_ratio())


CLASS_METRICS: dict[str, Callable[[bool], Column]] = {
    "signal_to_noise": _signal_to_noise,
    "t_test": _t_test,
    "ratio_of_classes": _ratio,
    "diff_of_classes": _diff,
    "log2_ratio_of_classes": _log2_ratio,
}


def class_metric(
    name: str,
    features: DataFrame,
    labels: DataFrame,
    *,
    median: bool = False,
    fix_low: bool = True,
    biased: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by.., feature, row_idx, score); features with no value at all in any
    labelled sample have no row."""
    stats = class_stats(
        features, labels, median=median, fix_low=fix_low, biased=biased, by=by
    )
    usable = (F.col("n0") > 0) & (F.col("n1") > 0)
    score = F.when(usable, CLASS_METRICS[name](biased)).otherwise(F.lit(0.0))
    return stats.select(*by, "feature", "row_idx", score.alias("score"))


def class_marker_stats(
    features: DataFrame, labels: DataFrame, metric: str = "signal_to_noise", **options
) -> DataFrame:
    """Score, centre and sd per class and overall; ``omit`` marks features
    lacking a class, whose numbers are missing."""
    median = options.get("median", False)
    stats = class_stats(features, labels, **options)
    both = features.filter(F.col("value").isNotNull()).join(labels.select("sample"), "sample")
    whole = both.groupBy("feature").agg(
        F.avg("value").alias("centre_all"),
        stddev_floor(
            F.sqrt(variance("value", options.get("biased", False))),
            F.avg("value"),
            options.get("fix_low", True),
        ).alias("sd_all"),
    )
    if median:
        whole = whole.drop("centre_all").join(
            group_median(both, ["feature"], "value", "centre_all"), "feature"
        )
    usable = (F.col("n0") > 0) & (F.col("n1") > 0)
    shown = [
        CLASS_METRICS[metric](options.get("biased", False)).alias("score"),
        *[F.col(c) for c in ("centre0", "centre1", "centre_all", "sd0", "sd1", "sd_all")],
    ]
    names = ["score", "centre0", "centre1", "centre_all", "sd0", "sd1", "sd_all"]
    return stats.join(whole, "feature").select(
        "feature",
        *[F.when(usable, c).alias(n) for c, n in zip(shown, names)],
        (~usable).alias("omit"),
    )


def _pairs(features: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    profile = labels.filter(F.col("num_value").isNotNull())
    return (
        features.filter(F.col("value").isNotNull())
        .join(profile.select(*by, "sample", "num_value"), "sample")
        .select(*by, "feature", "row_idx", "sample", "value", "num_value")
    )


def pearson(features: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x, y = F.col("value"), F.col("num_value")
    flat = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    score = F.when((F.count(F.lit(1)) > 1) & flat, F.corr(x, y))
    return _pairs(features, labels, by).groupBy(*by, "feature", "row_idx").agg(
        score.alias("score")
    )


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank descending within ``by``; tied values share their mean rank."""
    ordered = Window.partitionBy(*by).orderBy(F.col(value).desc())
    peers = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2


def spearman(features: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks; without ties this equals the
    squared-difference formula. Ranks give few different values: 12 decimals are
    kept, so that equal correlations are ties whatever way they were summed. A
    window holds one feature's samples."""
    key = [*by, "feature"]
    ranks = (
        _pairs(features, labels, by)
        .withColumn("value", average_rank("value", key))
        .withColumn("num_value", average_rank("num_value", key))
    )
    return pearson_of_pairs(ranks, by).withColumn("score", F.round("score", 12))


def pearson_of_pairs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x, y = F.col("value"), F.col("num_value")
    flat = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return pairs.groupBy(*by, "feature", "row_idx").agg(
        F.when((F.count(F.lit(1)) > 1) & flat, F.corr(x, y)).alias("score")
    )


def _profile_metric(score: Callable[[Column, Column], Column]):
    def metric(features: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return _pairs(features, labels, by).groupBy(*by, "feature", "row_idx").agg(
            score(F.col("value"), F.col("num_value")).alias("score")
        )

    return metric


cosine_distance = _profile_metric(
    lambda x, y: 1 - F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))
)
euclidean_distance = _profile_metric(lambda x, y: F.sqrt(F.sum((x - y) * (x - y))))
manhattan_distance = _profile_metric(lambda x, y: F.sum(F.abs(x - y)))

PROFILE_METRICS = {
    "pearson": pearson,
    "spearman": spearman,
    "cosine_distance": cosine_distance,
    "euclidean_distance": euclidean_distance,
    "manhattan_distance": manhattan_distance,
}


def passthrough_metric(scores: DataFrame) -> DataFrame:
    return scores


def score_features(
    name: str,
    features: DataFrame,
    labels: DataFrame,
    *,
    by: Sequence[str] = (),
    median: bool = False,
    fix_low: bool = True,
    biased: bool = False,
) -> DataFrame:
    """Any registered metric by name."""
    if name in CLASS_METRICS:
        return class_metric(
            name, features, labels, median=median, fix_low=fix_low, biased=biased, by=by
        )
    if name in PROFILE_METRICS:
        return PROFILE_METRICS[name](features, labels, by)
    known = sorted([*CLASS_METRICS, *PROFILE_METRICS])
    raise ValueError(f"unknown metric {name!r}; one of {known}")

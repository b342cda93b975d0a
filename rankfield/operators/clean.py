"""Row cleaning and filters on feature matrices and ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import POWER_GUARD, is_finite, is_negative, is_positive
from ..functions.scalars import with_one_row
from ..session import sent
from .rank import attach_sizes, number_rows, rerank

# Sample counts below which a run is refused.
MIN_SAMPLES_TWO_CLASS = 6
MIN_SAMPLES_PER_CLASS = 3
MIN_SAMPLES_NUMERIC = 3
# Fixed value: a data set of at most this many features is flagged.
FEW_FEATURES = 2000


def drop_all_missing_rows(features: DataFrame) -> DataFrame:
    keep = features.filter(F.col("value").isNotNull()).select("row_idx").distinct()
    return features.join(keep, "row_idx", "left_semi").select(features.columns)


def missing_value_profile(features: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Row counts by completeness. A cell with no row counts as missing."""
    rows = features.groupBy("row_idx").agg(
        F.count("value").alias("_have"),
        F.coalesce(F.max((F.abs("value") == F.lit(float("inf")))), F.lit(False)).alias("_inf"),
    )
    if n_samples is None:
        width = features.agg(F.count_distinct("sample").alias("_width"))
        rows = with_one_row(rows, width)
    else:
        rows = rows.withColumn("_width", F.lit(n_samples))
    have, width = F.col("_have"), F.col("_width")
    return rows.agg(
        F.count(F.when(have > 0, 1)).alias("n_features"),
        F.count(F.when((have > 0) & (have < width), 1)).alias("partly_missing"),
        F.count(F.when(have == 0, 1)).alias("all_missing"),
        F.coalesce(F.max("_inf"), F.lit(False)).alias("has_infinite"),
        (F.count(F.when(have > 0, 1)) <= FEW_FEATURES).alias("few_features"),
    )


def unique_features(features: DataFrame) -> DataFrame:
    """Of rows with one feature name the last survives.

    ``max(row_idx)`` per feature aggregates map-side, so a name that repeats in
    a third of all rows does not gather them in one task."""
    last = features.groupBy("feature").agg(F.max("row_idx").alias("row_idx"))
    return features.join(last, ["feature", "row_idx"], "left_semi").select(features.columns)


def duplicate_features(features: DataFrame) -> DataFrame:
    return (
        features.select("feature", "row_idx")
        .distinct()
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def unique_ranked(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last row of a repeated feature survives at the place of its first row."""
    kept = ranked.groupBy(*by, "feature").agg(
        F.min("rank").alias("rank"), F.max_by("score", "rank").alias("score")
    )
    return rerank(kept, by)


def extract_rows(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` is (feature, position); adds ``position``."""
    return features.join(wanted.select("feature", "position"), "feature").select(
        *features.columns, "position"
    )


def missing_rows(features: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(features.select("feature").distinct(), "feature", "left_anti")


def extract_rows_by_rank(
    features: DataFrame, members: DataFrame, ranked: DataFrame
) -> DataFrame:
    """Rows of each set's members with their rank, to be read in rank order."""
    placed = members.select("set_name", F.col("member").alias("feature")).join(
        ranked.select("feature", "rank"), "feature"
    )
    return features.join(placed, "feature").select("set_name", "rank", *features.columns)


def select_samples_for_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled samples only, renumbered class first, then position."""
    order = [F.col(c).asc() for c in ("class_idx", "position", "sample")]
    placed = number_rows(labels, order, ["phenotype"], name="sample_pos")
    return features.join(
        placed.select("sample", "class_name", "class_idx", "sample_pos"), "sample"
    ).select(*features.columns, "class_name", "class_idx", "sample_pos")


def sign_split(df: DataFrame, column: str, sign: str) -> DataFrame:
    """``pos`` keeps >= 0, ``neg`` keeps <= 0: zero is in both, missing in none."""
    return df.filter(is_positive(column) if sign == "pos" else is_negative(column))


def sign_count(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.count(F.when(is_positive(c), 1)).alias("n_pos"),
        F.count(F.when(is_negative(c), 1)).alias("n_neg"),
        F.count(F.lit(1)).alias("n_all"),
    )


def min_samples_check(labels: DataFrame, numeric: bool = False) -> DataFrame:
    """One row per rule: (check, actual, required, ok)."""
    if numeric:
        return labels.agg(F.count("num_value").alias("actual")).select(
            F.lit("samples").alias("check"),
            "actual",
            F.lit(MIN_SAMPLES_NUMERIC).alias("required"),
            (F.col("actual") >= MIN_SAMPLES_NUMERIC).alias("ok"),
        )
    total = labels.agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit("samples").alias("check"),
        "actual",
        F.lit(MIN_SAMPLES_TWO_CLASS).alias("required"),
    )
    each = labels.groupBy("class_name").agg(F.count(F.lit(1)).alias("actual")).select(
        F.concat(F.lit("class "), "class_name").alias("check"),
        "actual",
        F.lit(MIN_SAMPLES_PER_CLASS).alias("required"),
    )
    return total.unionByName(each).withColumn("ok", F.col("actual") >= F.col("required"))


def features_without_class_data(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features lacking any value in one of the two classes."""
    present = features.join(labels.select("sample", "class_idx"), "sample", "left")
    return (
        present.groupBy("feature")
        .agg(
            F.count(F.when(F.col("class_idx") == 0, F.col("value"))).alias("_n0"),
            F.count(F.when(F.col("class_idx") == 1, F.col("value"))).alias("_n1"),
        )
        .filter((F.col("_n0") == 0) | (F.col("_n1") == 0))
        .select("feature")
    )


def omit_features_without_class_data(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(
        sent(features_without_class_data(features, labels)), "feature", "left_anti"
    )


def adjust_infinite_ends(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs of non-finite scores at the two ends of a list become +-1e-6."""
    score = F.col("score")
    ends = ranked.groupBy(*by).agg(
        F.min(F.when(is_finite("score"), F.col("rank"))).alias("_lo"),
        F.max(F.when(is_finite("score"), F.col("rank"))).alias("_hi"),
    )
    joined = ranked.join(ends, list(by)) if by else with_one_row(ranked, ends)
    outside = (
        F.col("_lo").isNull() | (F.col("rank") < F.col("_lo")) | (F.col("rank") > F.col("_hi"))
    )
    small = F.when(score == F.lit(float("-inf")), -POWER_GUARD).otherwise(POWER_GUARD)
    return joined.withColumn("score", F.when(outside, small).otherwise(score)).select(
        ranked.columns
    )


def slice_matrix(features: DataFrame, rows: DataFrame, samples: DataFrame) -> DataFrame:
    """``rows`` is (feature, new_row), ``samples`` is (sample, new_col)."""
    return (
        features.join(rows, "feature")
        .join(samples, "sample")
        .select("new_row", "new_col", "feature", "sample", "value")
    )


def search_feature(df: DataFrame, text: str, column: str = "feature") -> DataFrame:
    """Rows whose ``column`` contains ``text``, any case."""
    return df.filter(F.upper(F.col(column)).contains(text.upper()))


def filter_results(
    results: DataFrame, condition: str, order_by: str, ascending: bool = True
) -> DataFrame:
    key = F.col(order_by)
    return results.filter(condition).orderBy(key.asc() if ascending else key.desc())

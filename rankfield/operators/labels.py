"""Sample labellings.

Table: (phenotype, sample, position, class_name, class_idx, num_value). A
labelling has as many rows as there are samples; derived labellings take a new
``phenotype`` name and so can be stacked in one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["phenotype", "sample", "position", "class_name", "class_idx", "num_value"]
REST = "REST"


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "phenotype",
        "sample",
        "position",
        "class_name",
        F.col("class_idx").cast("int").alias("class_idx"),
        F.col("num_value").cast("double").alias("num_value"),
    )


def _classes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("phenotype", "class_name").agg(F.min("class_idx").alias("class_idx"))


def _two_names(labels: DataFrame) -> DataFrame:
    """One row per labelling: the names of its class 0 and class 1."""
    return labels.groupBy("phenotype").agg(
        F.min(F.when(F.col("class_idx") == 0, F.col("class_name"))).alias("_a"),
        F.min(F.when(F.col("class_idx") == 1, F.col("class_name"))).alias("_b"),
    )


def labels_forward(labels: DataFrame) -> DataFrame:
    named = labels.join(_two_names(labels), "phenotype")
    return _shape(
        named.withColumn("phenotype", F.concat_ws("_versus_", "_a", "_b"))
    )


def labels_reversed(labels: DataFrame) -> DataFrame:
    named = labels.join(_two_names(labels), "phenotype")
    return _shape(
        named.withColumn("phenotype", F.concat_ws("_versus_", "_b", "_a")).withColumn(
            "class_idx", 1 - F.col("class_idx")
        )
    )


def labels_one_vs_rest(labels: DataFrame, both_ways: bool = False) -> DataFrame:
    """Each class against REST; a labelling of fewer than three classes is an error."""
    classes = F.array_sort(F.collect_set("class_name"))  # as many as there are classes
    few = F.raise_error(
        F.concat(F.lit("one class against the rest needs three classes: "), F.col("phenotype"))
    ).cast("array<string>")
    named = labels.join(
        labels.groupBy("phenotype")
        .agg(classes.alias("_classes"))
        .select("phenotype", F.when(F.size("_classes") < 3, few).otherwise(F.col("_classes")).alias("_classes")),
        "phenotype",
    ).select(*labels.columns, F.explode("_classes").alias("_one"))
    is_one = F.col("class_name") == F.col("_one")
    name = F.when(is_one, F.col("_one")).otherwise(F.lit(REST))
    out = _shape(
        named.withColumn("phenotype", F.concat(F.col("_one"), F.lit("_versus_" + REST)))
        .withColumn("class_name", name)
        .withColumn("class_idx", F.when(is_one, 0).otherwise(1))
    )
    if not both_ways:
        return out
    back = _shape(
        named.withColumn("phenotype", F.concat(F.lit(REST + "_versus_"), F.col("_one")))
        .withColumn("class_name", name)
        .withColumn("class_idx", F.when(is_one, 1).otherwise(0))
    )
    return out.unionByName(back)


def labels_all_pairs(labels: DataFrame) -> DataFrame:
    """Every ordered pair of classes; samples of other classes are left out.

    A sample appears once per other class and side: the class list of a
    labelling is exploded on each sample, no sample meets another."""
    classes = labels.groupBy("phenotype").agg(
        F.array_sort(F.collect_set("class_name")).alias("_classes")
    )
    other = labels.join(classes, "phenotype").select(
        *labels.columns, F.explode("_classes").alias("_other")
    ).filter(F.col("_other") != F.col("class_name"))
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("_side")
    sided = other.select(*other.columns, side)
    first = F.when(F.col("_side") == 0, F.col("class_name")).otherwise(F.col("_other"))
    second = F.when(F.col("_side") == 0, F.col("_other")).otherwise(F.col("class_name"))
    return _shape(
        sided.withColumn("phenotype", F.concat_ws("_versus_", first, second)).withColumn(
            "class_idx", F.col("_side")
        )
    )


def labels_single_class(labels: DataFrame) -> DataFrame:
    return _shape(
        labels.withColumn("phenotype", F.col("class_name")).withColumn("class_idx", F.lit(0))
    )


def labels_all_derived(labels: DataFrame) -> DataFrame:
    """All labellings each phenotype offers, by its own number of classes: one
    class itself, two classes both ways, more every class against the rest and
    every ordered pair, each with the single classes."""
    counted = labels.join(
        labels.groupBy("phenotype").agg(F.count_distinct("class_name").alias("_k")), "phenotype"
    )
    two = counted.filter("_k = 2").select(labels.columns)
    many = counted.filter("_k > 2").select(labels.columns)
    return (
        labels_single_class(labels)
        .unionByName(labels_forward(two))
        .unionByName(labels_reversed(two))
        .unionByName(labels_one_vs_rest(many, both_ways=True))
        .unionByName(labels_all_pairs(many))
    )


def labels_from_numeric(profile: DataFrame) -> DataFrame:
    """``profile`` is (phenotype, sample, position, num_value)."""
    return _shape(
        profile.withColumn("class_name", F.lit(None).cast("string")).withColumn(
            "class_idx", F.lit(None).cast("int")
        )
    )


def labels_from_feature(features: DataFrame, feature: str) -> DataFrame:
    row = features.filter(F.col("feature") == feature)
    return labels_from_numeric(
        row.select(
            F.col("feature").alias("phenotype"),
            "sample",
            F.col("sample_idx").alias("position"),
            F.col("value").alias("num_value"),
        )
    )


def labels_from_features(features: DataFrame, names: DataFrame) -> DataFrame:
    """One numeric labelling per feature named in ``names`` (feature)."""
    rows = features.join(names.select("feature").distinct(), "feature", "left_semi")
    return labels_from_numeric(
        rows.select(
            F.col("feature").alias("phenotype"),
            "sample",
            F.col("sample_idx").alias("position"),
            F.col("value").alias("num_value"),
        )
    )


def labels_from_sample_names(
    samples: DataFrame, chosen: DataFrame, phenotype: str, strict: bool = True
) -> DataFrame:
    """``samples`` is (sample, sample_idx), ``chosen`` is (name, class_name,
    class_idx); names match in any case, an unknown name is an error."""
    known = samples.withColumn("_key", F.lower("sample"))
    asked = chosen.withColumn("_key", F.lower("name"))
    joined = asked.join(known, "_key", "left")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("unknown sample "), F.col("name"))).cast("string")
        joined = joined.withColumn("sample", F.coalesce("sample", wrong))
    else:
        joined = joined.filter(F.col("sample").isNotNull())
    return _shape(
        joined.withColumn("phenotype", F.lit(phenotype))
        .withColumn("position", F.col("sample_idx"))
        .withColumn("num_value", F.lit(None).cast("double"))
    )


def split_by_class(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Values of each row with the class of their sample."""
    return features.join(
        labels.select("phenotype", "sample", "class_name", "class_idx"), "sample"
    ).select("phenotype", "feature", "class_name", "class_idx", "sample", "value")


def sync_profile(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Row value next to profile value by sample, missing values left out."""
    profile = labels.filter(F.col("num_value").isNotNull())
    return (
        features.filter(F.col("value").isNotNull())
        .join(profile.select("phenotype", "sample", "position", "num_value"), "sample")
        .select("phenotype", "feature", "row_idx", "position", "sample", "value", "num_value")
    )

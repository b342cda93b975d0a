"""Readers of sample labellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_na_token
from ..operators.labels import labels_from_features
from .lines import read_lines, require, source_name

# Marker lines and reserved column titles.
NUMERIC_MARK = "#numeric"
PROBES_MARK = "#probes"
NUMERIC_COLUMNS = ("NUMERIC", "FLOAT")
COMMENT_COLUMNS = ("COMMENT", "COMMENTS")


def _words(column: str = "line"):
    return F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")


def read_cls_categorical(spark: SparkSession, path: str) -> DataFrame:
    """Counts, class names, one label per sample; counts are checked. Labels
    bind to class names in order of first use."""
    lines = read_lines(spark, path, comments=True)
    counts = lines.filter("line_no = 0").select(
        "file",
        _words()[0].cast("int").alias("_n"),
        _words()[1].cast("int").alias("_k"),
    )
    names = lines.filter("line_no = 1").select(
        "file",
        F.filter(
            F.split(F.trim(F.regexp_replace("line", "^#", "")), r"\s+"), lambda x: x != ""
        ).alias("_names"),
    )
    items = lines.filter("line_no = 2").select(
        "file", F.posexplode(_words()).alias("position", "_label")
    )
    used = items.groupBy("file", "_label").agg(F.min("position").alias("_first"))
    # as many rows per file as there are classes
    order = Window.partitionBy("file").orderBy("_first")
    used = used.withColumn("class_idx", F.row_number().over(order) - 1)
    found = items.groupBy("file").agg(
        F.count(F.lit(1)).alias("_items"), F.count_distinct("_label").alias("_labels")
    )
    head = counts.join(names, "file").join(found, "file")
    good = (
        (F.col("_items") == F.col("_n"))
        & (F.col("_labels") == F.col("_k"))
        & (F.size("_names") == F.col("_k"))
    )
    head = head.withColumn(
        "file",
        require(
            good, F.concat(F.lit("item or class count differs: "), F.col("file")), F.col("file")
        ),
    )
    return (
        items.join(used, ["file", "_label"])
        .join(head.select("file", "_names"), "file")
        .select(
            source_name(F.col("file"), ".cls").alias("phenotype"),
            F.lit(None).cast("string").alias("sample"),
            F.col("position").cast("long").alias("position"),
            F.get("_names", F.col("class_idx")).alias("class_name"),
            "class_idx",
            F.lit(None).cast("double").alias("num_value"),
        )
    )


def read_cls_numeric(spark: SparkSession, path: str) -> DataFrame:
    """``#numeric``, then pairs of a ``#name`` line and a profile line."""
    lines = read_lines(spark, path, comments=True)
    is_name = F.col("line").startswith("#") & (
        (F.col("line_no") > 0) | (F.lower(F.trim("line")) != NUMERIC_MARK)
    )
    names = lines.filter(is_name).select(
        "file", F.trim(F.expr("substring(line, 2)")).alias("_name"), (F.col("line_no") + 1).alias("line_no")
    )
    profiles = names.join(lines, ["file", "line_no"], "left")
    text = require(
        F.col("line").isNotNull() & ~F.col("line").startswith("#"),
        F.concat(F.lit("profile line missing: "), F.col("_name")),
        F.col("line"),
    )
    cells = profiles.select("file", "_name", text.alias("line")).select(
        "file", "_name", F.posexplode(_words()).alias("position", "_v")
    )
    return cells.select(
        F.col("_name").alias("phenotype"),
        F.lit(None).cast("string").alias("sample"),
        F.col("position").cast("long").alias("position"),
        F.lit(None).cast("string").alias("class_name"),
        F.lit(None).cast("int").alias("class_idx"),
        F.col("_v").cast("double").alias("num_value"),
    )


def read_cls_by_sample(spark: SparkSession, path: str) -> DataFrame:
    """Sample table: each column is a labelling. A repeated sample is an error;
    ``na`` cells are left out; class numbers follow first use."""
    lines = read_lines(spark, path).withColumn(
        "_f", F.transform(F.split("line", "\t", -1), lambda x: F.trim(x))
    )
    head = lines.filter("line_no = 0").select("file", F.col("_f").alias("_head"))
    rows = lines.filter("line_no >= 1").join(head, "file")
    twice = rows.groupBy("file", F.col("_f")[0].alias("sample")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    twice = twice.select(
        "file",
        require(
            F.col("_n") == 1,
            F.concat(F.lit("sample named twice: "), F.col("sample")),
            F.col("sample"),
        ).alias("sample"),
    )
    cells = (
        rows.select(
            "file",
            F.col("_f")[0].alias("sample"),
            (F.col("line_no") - 1).alias("position"),
            "_head",
            F.posexplode(F.slice("_f", 2, 1 << 30)).alias("_col", "_text"),
        )
        .withColumn("phenotype", F.get("_head", F.col("_col") + 1))
        .filter(~F.upper("phenotype").isin(*COMMENT_COLUMNS))
        .filter(~is_na_token("_text") & (F.col("_text") != ""))
        .join(twice, ["file", "sample"])
    )
    numeric = F.upper("phenotype").isin(*NUMERIC_COLUMNS)
    used = cells.filter(~numeric).groupBy("file", "phenotype", "_text").agg(
        F.min("position").alias("_first")
    )
    # as many rows per labelling as there are classes
    order = Window.partitionBy("file", "phenotype").orderBy("_first")
    used = used.select(
        "file", "phenotype", "_text", (F.row_number().over(order) - 1).alias("class_idx")
    )
    return cells.join(used, ["file", "phenotype", "_text"], "left").select(
        "phenotype",
        "sample",
        "position",
        F.when(~numeric, F.col("_text")).alias("class_name"),
        "class_idx",
        F.when(numeric, F.col("_text").try_cast("double")).alias("num_value"),
    )


def read_probes_cls(spark: SparkSession, path: str, features: DataFrame) -> DataFrame:
    """``#probes``, then feature names; each feature's own row is a labelling."""
    lines = read_lines(spark, path, comments=True).filter("line_no >= 1")
    return labels_from_features(features, lines.select(F.trim("line").alias("feature")))

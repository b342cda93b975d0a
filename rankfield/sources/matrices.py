"""Feature matrix readers: text in, long cells out.

Cells: (dataset, row_idx, feature, description, sample_idx, sample, value). The
head of a file (one row) is joined to its lines by file name, and every line
expands to its cells where it is; neither lines nor cells are shuffled while all
different heads together stay below ``HEAD_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_feature_name, number_error, parse_number, split_fields
from ..operators.rank import beside
from ..session import cut
from .lines import is_text, number_lines, read_lines, require, source_name, split_lines, whole_line

CELLS = ["dataset", "row_idx", "feature", "description", "sample_idx", "sample", "value"]
MISSING_DESCRIPTION = "na"
HEAD_BYTES = 64 << 20  # sample names sent to every task, at most


def _under_heads(
    lines: DataFrame, head: DataFrame, extension: str, good: Column | None = None
) -> DataFrame:
    """The data lines with ``dataset``, ``row_idx`` and the columns of their file's head.

    ``head`` has file, ``header`` (sample names) and ``_skip``, the number of lines
    ahead of the data. Rows follow from line numbers and the row counts of the files
    ahead in the data set. ``good`` is checked for every file; it may use ``_have``,
    the rows that are there."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    ahead = Window.partitionBy("dataset").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    file = F.col("file")
    named = head
    head = (
        head.join(last, "file")
        .withColumn("_have", F.greatest(F.col("_last") + 1 - F.col("_skip"), F.lit(0)))
        .withColumn("dataset", source_name(file, extension))
        .withColumn("_ahead", F.coalesce(F.sum("_have").over(ahead), F.lit(0)))
    )
    if good is not None:
        wrong = F.concat(F.lit("row or column count differs: "), file)
        head = head.withColumn("file", require(F.coalesce(good, F.lit(False)), wrong, file))
    # the files of a matrix share their sample names: these are kept once, not a file
    key = F.sha2(F.array_join("header", "\t"), 256)
    names = cut(named.select(key.alias("_names"), "header").dropDuplicates(["_names"]))
    head = head.withColumn("_names", key).drop("_have", "_last", "header")
    size = names.agg(F.sum(F.length(F.array_join("header", "\t")))).head()[0] or 0
    if size <= HEAD_BYTES:
        rows = lines.join(beside(head, ["file"]), "file").join(F.broadcast(names), "_names")
    else:
        rows = lines.join(cut(head).join(names, "_names"), "file")
    return rows.filter(F.col("line_no") >= F.col("_skip")).withColumn(
        "row_idx", F.col("_ahead") + F.col("line_no") - F.col("_skip")
    )


def _cells(
    rows: DataFrame,
    feature: Column,
    description: Column,
    values: Column,
    calls: Column | None = None,
) -> DataFrame:
    """``rows`` come from :func:`_under_heads`, with the fields that ``feature`` ..
    ``values`` refer to."""
    placed = rows.select(
        "dataset",
        "row_idx",
        "header",
        clean_feature_name(feature).alias("feature"),
        F.when(F.trim(description) == "", MISSING_DESCRIPTION)
        .otherwise(F.trim(description))
        .alias("description"),
        values.alias("_values"),
        (calls if calls is not None else F.lit(None).cast("array<string>")).alias("_calls"),
    )
    # name, text and call travel together, so a cell carries no row arrays
    parts = [F.col("header").alias("n"), F.col("_values").alias("v")]
    if calls is not None:
        parts.append(F.col("_calls"))
    zipped = F.arrays_zip(*parts)
    cell = placed.select(
        "dataset",
        "row_idx",
        "feature",
        "description",
        F.posexplode(zipped).alias("sample_idx", "_c"),
    ).select(
        "dataset",
        "row_idx",
        "feature",
        "description",
        "sample_idx",
        F.col("_c.n").alias("_name"),
        F.col("_c.v").alias("_text"),
        (F.col("_c._calls") if calls is not None else F.lit(None)).cast("string").alias("_call"),
    )
    wrong = F.raise_error(F.concat(F.lit("not a number: "), F.col("_text"))).cast("double")
    missing = F.when(F.col("_text") == "", F.lit(None).cast("double"))  # most cells of a sparse matrix
    value = missing.when(number_error("_text"), wrong).otherwise(parse_number("_text"))
    out = cell.select(
        "dataset",
        "row_idx",
        "feature",
        "description",
        F.col("sample_idx").cast("long").alias("sample_idx"),
        F.trim("_name").alias("sample"),
        value.alias("value"),
        F.col("_call").alias("call"),
    )
    return out if calls is not None else out.drop("call")


def _fields(lines: DataFrame, line_no: int) -> DataFrame:
    return lines.filter(F.col("line_no") == line_no).select(
        "file", F.transform(F.split("line", "\t", -1), lambda x: F.trim(x)).alias("_f")
    )


def _names(skip: int) -> Column:
    """Sample names of a header line behind ``skip`` leading fields."""
    return F.filter(F.slice("_f", skip + 1, 1 << 30), lambda x: x != "").alias("header")


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """``#1.2`` line, counts line, header, rows; both counts are checked."""
    lines = read_lines(spark, path)
    counts = _fields(lines, 0).select(
        "file",
        F.col("_f")[0].try_cast("long").alias("_n_row"),
        F.get("_f", F.lit(1)).try_cast("int").alias("_n_col"),
    )
    head = counts.join(_fields(lines, 1).select("file", _names(2)), "file", "left")
    good = (F.size("header") == F.col("_n_col")) & (F.col("_have") == F.col("_n_row"))
    n = F.size("header")
    rows = _under_heads(lines, head.withColumn("_skip", F.lit(2)), ".gct", good).withColumn(
        "_f", split_fields("line", n + 2)
    )
    return _cells(rows, F.col("_f")[0], F.col("_f")[1], F.slice("_f", F.lit(3), n))


def read_txt_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Header NAME [DESCRIPTION] sample.., then rows."""
    lines = read_lines(spark, path)
    is_desc = F.upper(F.get("_f", F.lit(1))).isin("DESCRIPTION", "DESC")
    head = _fields(lines, 0).select(
        "file", F.when(is_desc, 2).otherwise(1).alias("_lead"), F.col("_f").alias("_head")
    ).select(
        "file",
        "_lead",
        F.filter(
            F.slice("_head", F.col("_lead") + 1, F.size("_head")), lambda x: x != ""
        ).alias("header"),
        F.lit(1).alias("_skip"),
    )
    rows = _under_heads(lines, head, ".txt").withColumn(
        "_f", split_fields("line", F.size("header") + F.col("_lead"))
    )
    description = F.when(F.col("_lead") == 2, F.col("_f")[1]).otherwise(F.lit(""))
    values = F.slice("_f", F.col("_lead") + 1, F.size("header"))
    return _cells(rows, F.col("_f")[0], description, values)


def read_res(spark: SparkSession, path: str) -> DataFrame:
    """Description, accession, then (value, call) pairs; adds ``call``. The second of
    the three leading lines may be blank; blank lines among the rows are dropped."""
    split = split_lines(spark, path, blanks=True)
    everything = number_lines(split)
    lead = everything.filter("line_no < 3").groupBy("file").agg(
        F.count_if(is_text(F.col("line"))).alias("_skip")
    )
    counts = _fields(everything, 2).select("file", F.col("_f")[0].try_cast("long").alias("_n_row"))
    head = _fields(everything, 0).select("file", _names(2)).join(lead, "file").join(
        counts, "file", "left"
    )
    n = F.size("header")
    lines = number_lines(split.filter(is_text(whole_line(F.col("_short")))))
    rows = _under_heads(lines, head, ".res", F.col("_have") == F.col("_n_row")).withColumn(
        "_f", split_fields("line", n * 2 + 2)
    )
    at = F.sequence(F.lit(0), n - 1)
    values = F.transform(at, lambda i: F.get(F.col("_f"), i * 2 + 2))
    calls = F.transform(at, lambda i: F.get(F.col("_f"), i * 2 + 3))
    return _cells(rows, F.col("_f")[1], F.col("_f")[0], values, calls)


def read_pcl(spark: SparkSession, path: str) -> DataFrame:
    """UNIQID, NAME, GWEIGHT (must be 1), samples; the EWEIGHT line is skipped."""
    lines = read_lines(spark, path)
    head = _fields(lines, 0).select("file", _names(3), F.lit(2).alias("_skip"))
    n = F.size("header")
    rows = _under_heads(lines, head, ".pcl").withColumn("_f", split_fields("line", n + 3))
    feature = require(
        F.col("_f")[2].try_cast("double") == 1.0,
        F.concat(F.lit("GWEIGHT must be 1: "), F.col("_f")[0]),
        F.col("_f")[0],
    )
    return _cells(rows, feature, F.col("_f")[1], F.slice("_f", F.lit(4), n))


def read_table(spark: SparkSession, path: str, numeric: bool = False) -> DataFrame:
    """Tab table with row names in the first column; ``numeric`` parses the
    other columns as numbers."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if not numeric:
        return raw
    name, *rest = raw.columns
    return raw.select(name, *[parse_number(F.col(f"`{c}`")).alias(c) for c in rest])

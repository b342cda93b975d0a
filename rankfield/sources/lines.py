"""Numbered text lines, in file order, without a sort and without reading a file in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import beside
from ..session import cut

# Runs of tabs, which are most of a sparse matrix, as lines are kept: what is replaced in turn, by what, and how many
# bytes shorter that is.
TAB_RUNS = (("\t" * 32, "\x01", 31), ("\x01" * 16, "\x02", 15), ("\t" * 8, "\x03", 7))


def source_name(path: Column, extension: str) -> Column:
    """Base name without extension. A folder ``x.ext/`` (or ``key=x.ext/``)
    holding part files is one source named ``x``."""
    ext = extension.replace(".", r"\.")
    folder = F.regexp_extract(path, rf"([^/]+){ext}/", 1)
    file_name = F.element_at(F.split(path, "/"), -1)
    plain = F.regexp_replace(file_name, rf"{ext}$", "")
    name = F.when(folder != "", F.regexp_replace(folder, "^[^=]*=", "")).otherwise(plain)
    return F.url_decode(name)


def is_text(line: Column) -> Column:
    """Whether ``line`` has more than tabs and spaces; seen at the first such character."""
    return line.rlike("[^\t ]")


def short_line(line: Column) -> Column:
    """``line`` with its runs of tabs shortened. A line that holds one of the marks itself is told by the lengths, since
    :func:`whole_line` would make it longer; it is kept as it is behind a tab of its own."""
    short, length = line, F.lit(0)
    for run, mark, less in TAB_RUNS:
        short = F.replace(short, F.lit(run), F.lit(mark))
        marks = F.octet_length(short) - F.octet_length(F.replace(short, F.lit(mark), F.lit("")))
        length = length + marks * less
    same = F.octet_length(short) + length == F.octet_length(line)
    return F.when(same, F.concat(F.lit(" "), short)).otherwise(F.concat(F.lit("\t"), line))


def whole_line(short: Column) -> Column:
    line = F.substring(short, F.lit(2), F.lit(1 << 30))
    full = line
    for run, mark, _ in reversed(TAB_RUNS):
        full = F.replace(full, F.lit(mark), F.lit(run))
    return F.when(F.startswith(short, F.lit(" ")), full).otherwise(line)


def split_lines(
    spark: SparkSession, path: str, *, comments: bool = False, blanks: bool = False
) -> DataFrame:
    """(file, _block, _short): the lines of every split, in their order, where they were
    read, with runs of tabs shortened (:func:`whole_line` gives the line); comment and blank
    lines are dropped unless asked for.

    The lines are checkpointed as they come, without a shuffle, so that all later
    uses see the same splits and tasks."""
    value = F.col("value")
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.when(value.endswith("\r"), F.regexp_replace(value, r"\r$", "")).otherwise(value).alias("line"),
        )
    )
    if not comments:
        lines = lines.filter(~F.ltrim("line").startswith("#"))
    if not blanks:
        lines = lines.filter(is_text(F.col("line")))
    return cut(lines.select("file", "_block", short_line(F.col("line")).alias("_short")))


def number_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of :func:`split_lines` or a filter of it, numbered from 0
    per file: the place inside a split plus the counts of the splits ahead of it. Only
    the counts are shuffled; a file has one per split."""
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    ahead = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    shifts = splits.select("file", "_block", (before - F.col("_first")).alias("_shift"))
    return placed.join(beside(shifts, ["file"]), ["file", "_block"]).select(
        "file", (F.col("_at") + F.col("_shift")).alias("line_no"), whole_line(F.col("_short")).alias("line")
    )


def read_lines(
    spark: SparkSession, path: str, *, comments: bool = False, blanks: bool = False
) -> DataFrame:
    """(file, line_no, line): lines numbered from 0 per file, after dropping
    comment and blank lines unless asked for."""
    return number_lines(split_lines(spark, path, comments=comments, blanks=blanks))


def require(ok: Column, message: Column | str, value: Column) -> Column:
    """``value`` where ``ok``; else the job fails with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, value).otherwise(F.raise_error(text).cast("string"))

"""Readers of set collections, ranked lists and id maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    clean_feature_name,
    collection_version,
    is_null_token,
    number_error,
    parse_number,
    split_fields,
)
from ..operators.idmap import first_probe
from ..operators.rank import rank_scores
from .lines import read_lines, require, source_name

SETS = ["collection", "set_name", "description", "member", "member_pos"]
# Column titles of an id map, and its mark for "no symbol".
PROBE_TITLE = "Probe Set ID"
SYMBOL_TITLE = "Gene Symbol"
TITLE_TITLE = "Gene Title"
NO_SYMBOL = "---"


def _unique_members(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("collection", "set_name", "description", "member")
        .agg(F.min("member_pos").alias("member_pos"))
        .select(SETS)
    )


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """One set per line: name (upper-cased), description, members. Lines need no
    order, so they are not numbered."""
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    )
    tokens = F.filter(F.split("line", "\t"), lambda x: x != "")
    # the check is part of what is exploded: no later filter can drop the line
    short = F.concat(F.lit("a set line needs two fields: "), F.get("_t", F.lit(0)))
    listed = F.when(F.size("_t") > 1, F.slice("_t", 3, 1 << 30)).otherwise(
        F.array(F.raise_error(short).cast("string"))
    )
    rows = raw.select("file", tokens.alias("_t")).select(
        source_name(F.col("file"), ".gmt").alias("collection"),
        F.upper(F.trim(F.get("_t", F.lit(0)))).alias("set_name"),
        F.trim(F.get("_t", F.lit(1))).alias("description"),
        F.posexplode(listed).alias("member_pos", "member"),
    )
    members = rows.withColumn("member", F.trim("member")).filter(~is_null_token("member"))
    return _unique_members(members)


def gmt_versions(spark: SparkSession, path: str, known_hosts: Sequence[str] = ()) -> DataFrame:
    """(source, kind, species, version) per collection file."""
    return _versions(spark, path, ".symbols.gmt", "sets", known_hosts)


def chip_versions(spark: SparkSession, path: str, known_hosts: Sequence[str] = ()) -> DataFrame:
    return _versions(spark, path, ".chip", "platform", known_hosts)


def _versions(spark, path, extension, kind, known_hosts) -> DataFrame:
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"))
        .distinct()
    )
    v = collection_version("file", extension, known_hosts)
    return files.select(
        F.col("file").alias("source"),
        F.lit(kind).alias("kind"),
        v["species"].alias("species"),
        v["version"].alias("version"),
    )


def read_gmx(spark: SparkSession, path: str) -> DataFrame:
    """Sets in columns: names, descriptions, then members downwards."""
    lines = read_lines(spark, path)
    head = lines.filter("line_no = 0").select(
        "file", F.filter(F.split("line", "\t"), lambda x: F.trim(x) != "").alias("_names")
    )
    fields = lines.join(head.select("file", F.size("_names").alias("_n")), "file").withColumn(
        "_f", split_fields("line", F.col("_n"))
    )
    square = require(
        F.size("_f") == F.col("_n"),
        F.concat(F.lit("more fields than sets: "), F.col("file")),
        F.col("file"),
    )
    cells = fields.select(
        square.alias("file"), "line_no", F.posexplode("_f").alias("_col", "_text")
    )
    names = cells.filter("line_no <= 1").groupBy("file", "_col").agg(
        F.max(F.when(F.col("line_no") == 0, F.upper("_text"))).alias("set_name"),
        F.max(F.when(F.col("line_no") == 1, F.col("_text"))).alias("description"),
    )
    members = cells.filter("line_no >= 2").filter(~is_null_token("_text"))
    return _unique_members(
        members.join(names, ["file", "_col"]).select(
            source_name(F.col("file"), ".gmx").alias("collection"),
            "set_name",
            "description",
            F.col("_text").alias("member"),
            (F.col("line_no") - 2).cast("int").alias("member_pos"),
        )
    )


def read_grp(spark: SparkSession, path: str) -> DataFrame:
    """One member per line; the file is the set."""
    lines = read_lines(spark, path)
    return _unique_members(
        lines.select(
            source_name(F.col("file"), ".grp").alias("collection"),
            source_name(F.col("file"), ".grp").alias("set_name"),
            F.lit(None).cast("string").alias("description"),
            F.trim("line").alias("member"),
            F.col("line_no").cast("int").alias("member_pos"),
        )
    )


def _rnk_rows(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path).withColumn("_f", split_fields("line", 2))
    header = (F.col("line_no") == 0) & (
        (F.lower(F.col("_f")[0]) == "name") | (F.lower(F.col("_f")[1]) == "rank")
    )
    wrong = F.raise_error(F.concat(F.lit("not a number: "), F.col("_f")[1])).cast("double")
    return lines.filter(~header).select(
        source_name(F.col("file"), ".rnk").alias("list_id"),
        "file",
        "line_no",
        clean_feature_name(F.col("_f")[0]).alias("feature"),
        # naming the line keeps a later not-null filter above the header filter
        F.when((F.col("line_no") >= 0) & number_error(F.col("_f")[1]), wrong)
        .otherwise(parse_number(F.col("_f")[1]))
        .alias("score"),
    )


def read_rnk(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, feature, score, rank), scores descending, rows without a score
    left out."""
    rows = _rnk_rows(spark, path).filter("score IS NOT NULL")
    placed = rows.withColumn("row_idx", F.struct("file", "line_no"))
    return rank_scores(placed, by=["list_id"]).select("list_id", "feature", "score", "rank")


def rnk_missing(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, n_features, n_missing)."""
    return _rnk_rows(spark, path).groupBy("list_id").agg(
        F.count("score").alias("n_features"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("n_missing"),
    )


def read_chip(spark: SparkSession, path: str) -> DataFrame:
    """(platform, probe, symbol, title); first of repeated probes kept."""
    lines = read_lines(spark, path).withColumn(
        "_f", F.transform(F.split("line", "\t", -1), lambda x: F.trim(x))
    )

    def place(title: str):
        return (F.array_position(F.transform("_f", lambda x: F.lower(x)), title.lower()) - 1).cast(
            "int"
        )

    # the check sits on a column that is no join key: a key's not-null test may
    # move below the header filter
    found = (place(PROBE_TITLE) >= 0) & (place(SYMBOL_TITLE) >= 0)
    lacking = F.concat(F.lit("probe or symbol column missing: "), F.col("file"))
    head = lines.filter("line_no = 0").select(
        "file",
        F.when(found, place(PROBE_TITLE)).otherwise(F.raise_error(lacking).cast("int")).alias("_p"),
        place(SYMBOL_TITLE).alias("_s"),
        place(TITLE_TITLE).alias("_t"),
    )

    def field(at: str):
        inside = F.when(F.col(at) >= 0, F.get("_f", F.col(at)))
        return F.coalesce(F.trim(inside), F.lit(""))

    rows = lines.filter("line_no >= 1").join(head, "file")
    symbol = field("_s")
    probes = rows.select(
        source_name(F.col("file"), ".chip").alias("platform"),
        F.struct("file", "line_no").alias("line"),
        field("_p").alias("probe"),
        F.when(symbol == NO_SYMBOL, "").otherwise(symbol).alias("symbol"),
        field("_t").alias("title"),
    ).filter("probe <> ''")
    return first_probe(probes, by=["platform"]).select("platform", "probe", "symbol", "title")

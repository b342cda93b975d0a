"""Id mapping and collapse of probes to symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_null_token
from ..session import spread, tasks_for
from .rank import rank_scores
from .select import group_median

MODES = ("max", "median", "mean", "sum", "absmax", "remap")


def annotate(df: DataFrame, id_map: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """Add ``symbol`` to rows keyed by ``feature`` (= probe)."""
    usable = id_map.select(
        F.col("probe").alias("feature"),
        F.when(~is_null_token("symbol"), F.trim("symbol")).alias("symbol"),
    )
    if keep_unmapped:
        return df.join(usable, "feature", "left").withColumn(
            "symbol", F.coalesce("symbol", "feature")
        )
    return df.join(usable.filter("symbol IS NOT NULL"), "feature")


def _combine(mode: str, value: str, order: str) -> Column:
    v = F.col(value)
    if mode == "max":
        return F.max(v)
    if mode == "mean":
        return F.avg(v)
    if mode == "sum":
        return F.sum(v)
    if mode == "absmax":
        return F.max_by(v, F.when(v.isNotNull(), F.struct(F.abs(v), -F.col(order))))
    if mode == "remap":
        more = F.raise_error(F.lit("several probes for one symbol")).cast("double")
        return F.when(F.count(F.lit(1)) > 1, more).otherwise(F.max(v))
    raise ValueError(f"unknown collapse mode {mode!r}; one of {MODES}")


def _grouped(
    df: DataFrame, by: list[str], mode: str, value: str, order: str, n: int | None = None
) -> DataFrame:
    """One value per group, in ``n`` tasks where given. All modes but the median aggregate
    map-side, or in those tasks; the median has its own way with large groups."""
    if mode == "median":
        return group_median(df, by, value, value, tasks=n)
    return spread(df, n, *by).groupBy(*by).agg(_combine(mode, value, order).alias(value))


def collapse(
    features: DataFrame, id_map: DataFrame, mode: str = "max", keep_unmapped: bool = False
) -> DataFrame:
    """Per (symbol, sample), over the probes of the symbol, skipping missing
    values. Result rows are numbered by nothing but their symbol."""
    n = tasks_for(features)
    mapped = annotate(spread(features, n, "feature"), id_map, keep_unmapped)
    return _grouped(mapped, ["symbol", "sample"], mode, "value", "row_idx", n).withColumnRenamed(
        "symbol", "feature"
    )


def remap_conflicts(features: DataFrame, id_map: DataFrame) -> DataFrame:
    """Symbols that 1:1 renaming has to refuse."""
    return (
        annotate(features.select("feature").distinct(), id_map)
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n_probes"))
        .filter("n_probes > 1")
    )


def remap_only(features: DataFrame, id_map: DataFrame) -> DataFrame:
    """Rename probes to symbols; several probes per symbol fail the job."""
    return collapse(features, id_map, "remap")


def collapse_titles(features: DataFrame, id_map: DataFrame) -> DataFrame:
    """First title of each symbol, by row order of its probes."""
    rows = features.select("feature", "row_idx").distinct()
    titles = id_map.select(F.col("probe").alias("feature"), "title")
    return (
        annotate(rows, id_map)
        .join(titles, "feature")
        .groupBy("symbol")
        .agg(F.min_by("title", "row_idx").alias("title"))
    )


def collapse_ranked_list(
    ranked: DataFrame, id_map: DataFrame, mode: str = "max", by: Sequence[str] = ()
) -> DataFrame:
    """Collapse scores and rank again, descending."""
    mapped = annotate(ranked, id_map)
    scores = _grouped(mapped, [*by, "symbol"], mode, "score", "rank")
    return rank_scores(scores.withColumnRenamed("symbol", "feature"), by=by)


def collapse_details(features: DataFrame, id_map: DataFrame) -> DataFrame:
    """(symbol, n_probes, probe): the probes of every symbol as rows, so a symbol
    of very many probes is no single value."""
    probes = annotate(features.select("feature").distinct(), id_map)
    counts = probes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_probes"))
    return probes.join(counts, "symbol").select(
        "symbol", "n_probes", F.col("feature").alias("probe")
    )


def map_sets_to_platform(sets: DataFrame, id_map: DataFrame) -> DataFrame:
    """Every member symbol becomes all its probes on the target platform."""
    targets = id_map.filter(~is_null_token("symbol")).select(
        F.trim("symbol").alias("member"), F.col("probe").alias("target")
    )
    pairs = sets.select("set_name", "member").join(targets, "member")
    return pairs.select("set_name", F.col("target").alias("member")).distinct()


def mapping_details(sets: DataFrame, id_map: DataFrame) -> DataFrame:
    """Per set: members, distinct targets, members with at least one target."""
    targets = id_map.filter(~is_null_token("symbol")).select(
        F.trim("symbol").alias("member"), F.col("probe").alias("target")
    )
    joined = sets.select("set_name", "member").join(targets, "member", "left")
    members = joined.groupBy("set_name", "member").agg(F.count("target").alias("_t"))
    counts = members.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("source_members"),
        F.count(F.when(F.col("_t") > 0, 1)).alias("members_mapped"),
    )
    distinct = joined.groupBy("set_name").agg(F.count_distinct("target").alias("target_members"))
    return counts.join(distinct, "set_name").select(
        "set_name", "source_members", "target_members", "members_mapped"
    )


def member_targets(sets: DataFrame, id_map: DataFrame) -> DataFrame:
    """One row per (set, member, target); a member without any is ``invalid``."""
    targets = id_map.filter(~is_null_token("symbol")).select(
        F.trim("symbol").alias("member"), F.col("probe").alias("target")
    )
    return sets.select("set_name", "member").join(targets, "member", "left").select(
        "set_name", "member", F.coalesce("target", F.lit("invalid")).alias("target")
    )


def check_species_version(versions: DataFrame) -> DataFrame:
    """``versions`` is (source, kind, species, version), one row per collection
    or platform, NULL where unknown. Species of known sources must agree
    (error); versions must be all unknown or all known and equal (warning)."""
    return versions.agg(
        F.count_distinct("species").alias("n_species"),
        F.count_distinct("version").alias("n_versions"),
        F.count(F.when(F.col("version").isNull(), 1)).alias("n_unknown"),
        F.count(F.lit(1)).alias("n_sources"),
    ).select(
        "n_species",
        "n_versions",
        "n_unknown",
        (F.col("n_species") <= 1).alias("species_ok"),
        (
            (F.col("n_unknown") == F.col("n_sources"))
            | ((F.col("n_unknown") == 0) & (F.col("n_versions") == 1))
        ).alias("version_ok"),
    )


def first_probe(id_map: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the first of repeated probes (by ``line``), aggregating map-side."""
    return id_map.groupBy(*by, "probe").agg(
        F.min_by(F.struct("symbol", "title"), "line").alias("_first")
    ).select(*by, "probe", "_first.symbol", "_first.title")

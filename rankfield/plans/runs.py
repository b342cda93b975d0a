"""Entry points that compose the operators."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import (
    min_samples_check,
    omit_features_without_class_data,
    unique_features,
    unique_ranked,
)
from ..operators.enrich import hits, pick_extreme, score_at
from ..operators.idmap import (
    check_species_version,
    collapse,
    collapse_details,
    collapse_ranked_list,
    collapse_titles,
    map_sets_to_platform,
    mapping_details,
)
from ..operators.leading import leading_edge_members, leading_edge_stats
from ..operators.metrics import CLASS_METRICS, score_features
from ..operators.nulls import null_by_labels, null_by_sets, null_by_sets_of_lists
from ..operators.overlap import (
    incidence_matrix,
    jaccard_histogram,
    jaccard_matrix,
    leading_edge_sets,
    member_frequency,
    score_incidence,
)
from ..operators.rank import attach_sizes, number_rows, rank_features
from ..operators.reports import permutation_quality_warnings, run_summary
from ..operators.sets import (
    DEFAULT_MAX,
    DEFAULT_MIN,
    filter_sets_by_list,
    filter_sets_by_size,
    require_sets,
)
from ..operators.signif import significance, validate_results
from ..session import cut
from ..sources.result_files import read_results_db, results_to_hits, results_to_null

COLLAPSE_CHOICES = ("Collapse", "Remap_Only", "No_Collapse")


@dataclass
class Run:
    """Tables of one enrichment run."""

    ranked: DataFrame
    sets: DataFrame
    hits: DataFrame
    results: DataFrame
    null_es: DataFrame
    warnings: DataFrame  # (warning, applies): rules that a run should be read with

    def leading_edge(self) -> DataFrame:
        return leading_edge_members(self.hits, self.results)

    def leading_edge_stats(self) -> DataFrame:
        return leading_edge_stats(self.hits, self.results)

    def summary(self, all_sets: DataFrame, native_features: DataFrame) -> DataFrame:
        """(key, value) counts of the run against the sets and features it was given, its warnings included."""
        return run_summary(self.results, self.ranked, all_sets, native_features, self.warnings)

    def save(self, path: str) -> None:
        """All tables as Parquet below ``path``."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


TABLES = tuple(f.name for f in fields(Run))

# These metrics divide by the spread within a class.
SPREAD_METRICS = ("signal_to_noise", "t_test")


def load_run(spark: SparkSession, path: str) -> Run:
    """A run that :meth:`Run.save` stored."""
    return Run(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def run_of_document(spark: SparkSession, path: str, ranked: DataFrame, *, empty_ok: bool = False) -> Run:
    """The run that a stored result document describes; ``ranked(feature, score, rank)`` is the list it names.

    Hits, profiles and the null are the document's arrays, hits get their features and scores from the list. A document
    whose hits lie outside the list, or whose sets or null do not fit together, is an error; so is one without sets,
    unless ``empty_ok``."""
    stored = cut(read_results_db(spark, path))
    results = stored.select(
        "set_name", F.size("hit_ranks").cast("long").alias("size"), "es", "rank_at_max", "score_at_max", "nes", "np", "fdr", "fwer"
    )
    null_es = results_to_null(stored)
    listed = ranked.select("feature", "score", "rank")
    found = results_to_hits(stored).withColumn("hit_no", F.col("hit_no").cast("long")).join(listed, "rank", "left")
    outside = F.raise_error(F.concat(F.lit("no such rank in the list: "), F.col("rank").cast("string"))).cast("string")
    found = found.withColumn("feature", F.when(F.col("feature").isNotNull(), F.col("feature")).otherwise(outside))
    sized = attach_sizes(found.join(results.select("set_name", F.col("size").alias("n_hits")), "set_name"), listed)
    scored = cut(sized.select("set_name", "feature", "score", "rank", "hit_no", "n_hits", "n_features", "running_es"))
    _validated(results, null_es, empty_ok=empty_ok)
    sets = scored.select("set_name", F.col("feature").alias("member"))
    return Run(listed, sets, scored, results, null_es, run_warnings(results))


def run_warnings(results: DataFrame, labels: DataFrame | None = None, metric: str = "") -> DataFrame:
    """(warning, applies) of a run; the rules on classes and samples hold where labels were permuted, those on classes
    for metrics of two classes."""
    if labels is None:
        none = results.sparkSession.createDataFrame([], "sample string, class_idx int")
        return permutation_quality_warnings(none, results, phenotype_permutation=False)
    found = permutation_quality_warnings(labels, results)
    if metric in CLASS_METRICS:
        return found
    applies = F.col("applies") & ~F.col("warning").startswith("class_")
    return found.select("warning", applies.alias("applies"))


def check_labels(labels: DataFrame, metric: str) -> None:
    """Fail where the metric does not go with the labelling, or the classes are too small for it."""
    if metric in CLASS_METRICS:
        classes = labels.agg(
            F.count(F.when(~F.col("class_idx").isin(0, 1) | F.col("class_idx").isNull(), 1)).alias("other"),
            F.count(F.when(F.col("class_idx") == 0, 1)).alias("a"),
            F.count(F.when(F.col("class_idx") == 1, 1)).alias("b"),
        ).first()
        if classes.other or not classes.a or not classes.b:
            raise ValueError(f"{metric} needs a labelling of two classes")
        if metric not in SPREAD_METRICS:
            return
        bad = min_samples_check(labels).filter("not ok")
    else:
        if labels.filter("num_value is not null").isEmpty():
            raise ValueError(f"{metric} needs a numeric labelling")
        bad = min_samples_check(labels, numeric=True).filter("not ok")
    first = bad.first()
    if first is not None:
        raise ValueError(f"{metric}: {first.check} has {first.actual} samples, {first.required} are needed")


def check_sources(versions: DataFrame | None) -> None:
    """Fail where collections and platforms are of several species, warn where of several versions.
    ``versions`` is (source, kind, species, version)."""
    if versions is None:
        return
    found = check_species_version(versions).first()
    if not found.species_ok:
        raise ValueError("collections and platforms are of several species")
    if not found.version_ok:
        warnings.warn("collections and platforms are of several versions", stacklevel=3)


def _validated(results: DataFrame, null_es: DataFrame, key=(), empty_ok: bool = False) -> None:
    """Fail where a run has no results (unless ``empty_ok``), repeats a set or lacks permutations of one."""
    if key:
        name = F.concat_ws("\x01", *[F.col(k).cast("string") for k in (*key, "set_name")])
        results, null_es = results.withColumn("set_name", name), null_es.withColumn("set_name", name)
    bad = validate_results(results, null_es).filter("not ok")
    bad = (bad.filter("check <> 'non_empty'") if empty_ok else bad).first()
    if bad is not None:
        raise ValueError(f"results fail the check {bad.check}: {bad.n_bad} rows")


def _some_sets(kept: DataFrame, empty_ok: bool) -> bool:
    """Whether the size filter left a set; fails where it did not, unless ``empty_ok``."""
    if not empty_ok:
        require_sets(kept)
    return not kept.isEmpty()


def _no_null(kept: DataFrame, key=()) -> DataFrame:
    """The null of no sets."""
    return kept.select(*key, "set_name", F.lit(0).alias("perm"), F.lit(0.0).alias("es")).filter(F.lit(False))


def _finish(ranked, kept, null_es, scheme: str, norm: str, key=(), labels=None, metric: str = "", empty_ok: bool = False) -> Run:
    scored = cut(hits(ranked, kept, scheme, key))
    es = cut(score_at(pick_extreme(scored, scheme, key), ranked, key))
    null_es = cut(null_es)
    results = cut(significance(es, null_es, norm, key))
    _validated(results, null_es, key, empty_ok)
    return Run(ranked, kept, scored, results, null_es, run_warnings(results, labels, metric))


def enrich_ranked(
    ranked: DataFrame,
    sets: DataFrame,
    id_map: DataFrame | None = None,
    *,
    collapse_choice: str = "No_Collapse",
    collapse_mode: str = "max",
    set_min: int = DEFAULT_MIN,
    set_max: int = DEFAULT_MAX,
    nperm: int = 1000,
    seed: int = 149,
    scheme: str = "weighted",
    norm: str = "meandiv",
    versions: DataFrame | None = None,
    empty_ok: bool = False,
) -> Run:
    """Enrichment of an externally ranked list; the null is random sets.
    An empty collapsed list, no set left and incomplete results are errors; with ``empty_ok`` a run
    without sets is a run of empty tables."""
    check_sources(versions)
    listed = unique_ranked(ranked)
    if collapse_choice != "No_Collapse":
        mode = "remap" if collapse_choice == "Remap_Only" else collapse_mode
        listed = collapse_ranked_list(listed, id_map, mode)
    listed = cut(listed.select("feature", "score", "rank"))
    if listed.isEmpty():
        raise ValueError("no feature is left to rank")
    kept = cut(filter_sets_by_size(sets, listed, set_min, set_max))
    some = _some_sets(kept, empty_ok)
    null_es = null_by_sets(listed, kept, nperm, seed, scheme) if some else _no_null(kept)
    return _finish(listed, kept, null_es, scheme, norm, empty_ok=empty_ok)


def enrich_lists(
    ranked: DataFrame,
    sets: DataFrame,
    by: str = "list_id",
    id_map: DataFrame | None = None,
    *,
    collapse_choice: str = "No_Collapse",
    collapse_mode: str = "max",
    set_min: int = DEFAULT_MIN,
    set_max: int = DEFAULT_MAX,
    nperm: int = 1000,
    seed: int = 149,
    scheme: str = "weighted",
    norm: str = "meandiv",
    versions: DataFrame | None = None,
    empty_ok: bool = False,
) -> Run:
    """:func:`enrich_ranked` for a table of lists, as one job instead of one per
    list; every table of the run carries ``by``."""
    check_sources(versions)
    key = [by]
    listed = unique_ranked(ranked, key)
    if collapse_choice != "No_Collapse":
        mode = "remap" if collapse_choice == "Remap_Only" else collapse_mode
        listed = collapse_ranked_list(listed, id_map, mode, key)
    listed = cut(listed.select(by, "feature", "score", "rank"))
    if listed.isEmpty():
        raise ValueError("no feature is left to rank")
    kept = cut(filter_sets_by_list(sets, listed, key, set_min, set_max))
    some = _some_sets(kept, empty_ok)
    null_es = null_by_sets_of_lists(listed, kept, nperm, key, seed, scheme) if some else _no_null(kept, key)
    return _finish(listed, kept, null_es, scheme, norm, key, empty_ok=empty_ok)


def prepare_matrix(
    features: DataFrame,
    labels: DataFrame,
    id_map: DataFrame | None,
    collapse_choice: str,
    collapse_mode: str,
    numeric: bool,
) -> DataFrame:
    """Unique rows, collapsed, labelled samples only, both classes present."""
    cells = unique_features(features)
    if collapse_choice != "No_Collapse":
        mode = "remap" if collapse_choice == "Remap_Only" else collapse_mode
        by_symbol = collapse(cells, id_map, mode)
        numbers = number_rows(
            by_symbol.select("feature").distinct(), [F.col("feature").asc()], name="row_idx"
        )
        cells = by_symbol.join(numbers, "feature")
    cells = cells.join(labels.select("sample").distinct(), "sample", "left_semi").select(
        "row_idx", "feature", "sample", "value"
    )
    return cells if numeric else omit_features_without_class_data(cells, labels)


def enrich_matrix(
    features: DataFrame,
    labels: DataFrame,
    sets: DataFrame,
    id_map: DataFrame | None = None,
    *,
    collapse_choice: str = "No_Collapse",
    collapse_mode: str = "max",
    metric: str = "signal_to_noise",
    sort: str = "real",
    ascending: bool = False,
    permute: str = "phenotype",
    permutation_kind: str = "no_balance",
    set_min: int = DEFAULT_MIN,
    set_max: int = DEFAULT_MAX,
    nperm: int = 1000,
    seed: int = 149,
    scheme: str = "weighted",
    norm: str = "meandiv",
    versions: DataFrame | None = None,
    empty_ok: bool = False,
    **metric_options,
) -> Run:
    """Enrichment of a matrix against a labelling; the null permutes labels
    (``phenotype``) or draws random sets (``gene_set``).

    A metric that does not go with the labelling, too few samples, an empty
    collapsed matrix, no set left and incomplete results are errors; with
    ``empty_ok`` a run without sets is a run of empty tables."""
    check_sources(versions)
    check_labels(labels, metric)
    numeric = metric not in CLASS_METRICS
    cells = cut(
        prepare_matrix(features, labels, id_map, collapse_choice, collapse_mode, numeric)
    )
    scores = score_features(metric, cells, labels, **metric_options)
    ranked = cut(
        rank_features(scores, mode=sort, ascending=ascending).select("feature", "score", "rank")
    )
    if ranked.isEmpty():
        raise ValueError("no feature is left to rank")
    kept = cut(filter_sets_by_size(sets, ranked, set_min, set_max))
    if not _some_sets(kept, empty_ok):
        null_es = _no_null(kept)
    elif permute == "gene_set":
        null_es = null_by_sets(ranked, kept, nperm, seed, scheme)
    else:
        null_es = null_by_labels(
            cells, labels, kept, nperm, seed, metric, scheme, permutation_kind,
            mode=sort, ascending=ascending, **metric_options,
        )
    permuted = labels if permute != "gene_set" else None
    return _finish(ranked, kept, null_es, scheme, norm, labels=permuted, metric=metric, empty_ok=empty_ok)


def collapse_dataset(
    features: DataFrame, id_map: DataFrame, mode: str = "max"
) -> tuple[DataFrame, DataFrame]:
    """(collapsed cells with titles, probes per symbol)."""
    cells = unique_features(features)
    titles = collapse_titles(cells, id_map).withColumnRenamed("symbol", "feature")
    collapsed = collapse(cells, id_map, mode).join(titles, "feature", "left")
    return collapsed, collapse_details(cells, id_map)


def map_sets(sets: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets on the target platform, mapping counts)."""
    return map_sets_to_platform(sets, id_map), mapping_details(sets, id_map)


def leading_edge(run: Run, set_names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Leading-edge analysis of chosen sets; without a choice the full
    restricted sets are analysed."""
    if set_names is None:
        chosen = run.sets.select("set_name", "member")
    else:
        edge = leading_edge_sets(run.leading_edge())
        chosen = edge.join(set_names.select("set_name").distinct(), "set_name", "left_semi")
    chosen = cut(chosen)
    return {
        "members": chosen,
        "incidence": incidence_matrix(chosen),
        "scores": score_incidence(chosen, run.ranked),
        "jaccard": jaccard_matrix(chosen),
        "frequency": member_frequency(chosen),
        "histogram": jaccard_histogram(chosen),
    }

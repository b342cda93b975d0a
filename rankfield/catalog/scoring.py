"""Metrics, statistic primitives, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import clean, label_null, measures, metrics, nulls, rank, reports
from ..session import cut, release, sent, spread, tasks_for
from .base import MATRIX_RUN, PERMS, Entry, floor_sql, r6, sql

ENTRIES: dict[str, Entry] = {}


def add(name: str, query, twin: str | None, **replaced: str) -> None:
    ENTRIES[name] = Entry(query, sql(twin, **replaced) if twin else None)


# ---- class metrics ----------------------------------------------------------

_FORMS = {
    "signal_to_noise": "(mean0 - mean1) / (sd0 + sd1)",
    "t_test": "(mean0 - mean1) / sqrt(sd0 * sd0 / n0 + sd1 * sd1 / n1)",
    "ratio_of_classes": "mean0 / nullif(mean1, 0)",
    "diff_of_classes": "mean0 - mean1",
    "log2_ratio_of_classes": "log2(mean0 / nullif(mean1, 0))",
}


def _class_metric(name: str, **options):
    return lambda spark, d: r6(
        metrics.class_metric(name, i.features(spark, d), i.side_labels(spark, d), **options),
        "score",
    )


def _class_sql(form: str) -> str:
    return f"""
SELECT feature, row_idx,
  round(CASE WHEN n0 > 0 AND n1 > 0 THEN {form} ELSE 0 END, 6) AS score
FROM class_sds"""


for _name, _form in _FORMS.items():
    add(_name, _class_metric(_name), _class_sql(_form))
add(
    "signal_to_noise_median",
    _class_metric("signal_to_noise", median=True),
    _class_sql("(median0 - median1) / (sd0 + sd1)"),
)
add(
    "t_test_biased",
    _class_metric("t_test", biased=True, fix_low=False),
    _class_sql(
        "CASE WHEN least(n0, n1) <= 1 THEN 0 ELSE (mean0 - mean1) / nullif(sqrt("
        "raw0 * raw0 * (n0 - 1) / n0 / nullif(n0 - 1, 0)"
        " + raw1 * raw1 * (n1 - 1) / n1 / nullif(n1 - 1, 0)), 0) END"
    ),
)

# ---- profile metrics --------------------------------------------------------


def _profile(name: str, source=i.features, labels=i.side_labels):
    return lambda spark, d: r6(
        metrics.PROFILE_METRICS[name](source(spark, d), labels(spark, d)), "score"
    )


_PEARSON = """round(CASE WHEN count(*) > 1 AND var_pop({x}) > 0 AND var_pop({y}) > 0
  THEN corr({x}, {y}) END, 6)"""
add(
    "pearson",
    _profile("pearson"),
    f"""
SELECT feature, row_idx, {_PEARSON.format(x="value", y="num_value")} AS score
FROM profile_cells GROUP BY feature, row_idx""",
)
_RANKED_CELLS = """(SELECT feature, row_idx,
    rank() OVER (PARTITION BY feature ORDER BY value DESC)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY feature ORDER BY num_value DESC)
      + (count(*) OVER (PARTITION BY feature, num_value) - 1) / 2.0 AS y
  FROM {cells}) t"""
add(
    "spearman",
    _profile("spearman", i.dense_features, i.vector_labels),
    f"""
SELECT feature, row_idx, {_PEARSON.format(x="x", y="y")} AS score
FROM {_RANKED_CELLS.format(cells="dense_profile_cells")} GROUP BY feature, row_idx""",
)
add(
    "spearman_sparse",
    _profile("spearman"),
    f"""
SELECT feature, row_idx, {_PEARSON.format(x="x", y="y")} AS score
FROM {_RANKED_CELLS.format(cells="profile_cells")} GROUP BY feature, row_idx""",
)
add(
    "cosine_distance",
    _profile("cosine_distance"),
    """
SELECT feature, row_idx, round(1 - sum(value * num_value)
  / nullif(sqrt(sum(value * value) * sum(num_value * num_value)), 0), 6) AS score
FROM profile_cells GROUP BY feature, row_idx""",
)
add(
    "euclidean_distance",
    _profile("euclidean_distance"),
    """
SELECT feature, row_idx, round(sqrt(sum((value - num_value) ** 2)), 6) AS score
FROM profile_cells GROUP BY feature, row_idx""",
)
add(
    "manhattan_distance",
    _profile("manhattan_distance"),
    """
SELECT feature, row_idx, round(sum(abs(value - num_value)), 6) AS score
FROM profile_cells GROUP BY feature, row_idx""",
)
add(
    "passthrough_metric",
    lambda spark, d: metrics.passthrough_metric(i.scores(spark, d)),
    "SELECT feature, row_idx, score FROM scores",
)
_STATS = ("score", "centre0", "centre1", "centre_all", "sd0", "sd1", "sd_all")
add(
    "class_marker_stats",
    lambda spark, d: r6(
        metrics.class_marker_stats(i.features(spark, d), i.side_labels(spark, d)), *_STATS
    ),
    f"""
SELECT c.feature,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round((mean0 - mean1) / (sd0 + sd1), 6) END AS score,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(mean0, 6) END AS centre0,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(mean1, 6) END AS centre1,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(m, 6) END AS centre_all,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(sd0, 6) END AS sd0,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round(sd1, 6) END AS sd1,
  CASE WHEN n0 > 0 AND n1 > 0 THEN round({floor_sql("s", "m")}, 6) END AS sd_all,
  NOT (n0 > 0 AND n1 > 0) AS omit
FROM class_sds c JOIN (SELECT feature, avg(value) AS m,
    coalesce(stddev_samp(value), 0) AS s FROM class_cells GROUP BY feature) w USING (feature)""",
)

# ---- statistic primitives ---------------------------------------------------

add(
    "variance",
    lambda spark, d: r6(
        measures.variances(i.features(spark, d)), "var_biased", "var_unbiased", digits=2
    ),
    """
SELECT feature, round(var_pop(value), 2) AS var_biased,
  round(CASE WHEN count(value) = 1 THEN 0 ELSE var_samp(value) END, 2) AS var_unbiased
FROM features GROUP BY feature""",
)
add(
    "stddev_floor",
    lambda spark, d: r6(
        measures.floored_stddev(i.features(spark, d)), "mean", "sd", "sd_floor"
    ),
    f"""
SELECT feature, round(m, 6) AS mean, round(s, 6) AS sd,
  round({floor_sql("s", "m")}, 6) AS sd_floor
FROM (SELECT feature, avg(value) AS m,
  CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS s
  FROM features GROUP BY feature)""",
)
add(
    "missing_safe_stats",
    lambda spark, d: r6(
        measures.missing_safe_stats(i.order_features(spark, d)), "mean", "median", "sum", "max"
    ),
    """
SELECT feature, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(sum(value), 6) AS sum, round(max(value), 6) AS max
FROM order_features GROUP BY feature""",
)

_AGGREGATES = {"mean": "avg", "median": "median", "sum": "sum", "max": "max"}
for _stat, _function in _AGGREGATES.items():

    def _one_stat(spark, d, stat=_stat):
        return r6(measures.missing_safe_stat(i.features(spark, d), stat), "value")

    add(
        _stat,
        _one_stat,
        f"SELECT feature, round({_function}(value), 6) AS value FROM features GROUP BY feature",
    )


def _deviation(spark, d):
    cells = i.dense_features(spark, d)
    return r6(
        measures.max_deviation(cells, "value", "sample_idx", ["feature"]), "max_dev"
    )


add(
    "max_deviation",
    _deviation,
    """
SELECT feature, round(value, 6) AS max_dev, sample_idx AS max_dev_index FROM dense_features
QUALIFY row_number() OVER (PARTITION BY feature
  ORDER BY floor(abs(value) * 1e9 + 0.5) DESC, sign(value) DESC, sample_idx) = 1""",
)
add(
    "range_mean",
    lambda spark, d: r6(measures.range_mean(i.ranked(spark, d), 30), "mean_score"),
    """
SELECT floor(((rank + 1) * 30 - 1) / c.n::DOUBLE)::BIGINT AS bin,
  round(avg(score), 6) AS mean_score, count(*) AS n
FROM ranked, (SELECT count(*) AS n FROM ranked) c GROUP BY 1""",
)
_WEIGHTS = ("weight_pos", "weight_neg", "frac_pos", "frac_neg", "weight_frac_pos", "weight_frac_neg")
_WEIGHTS_SQL = """
SELECT *, n_pos / (n_pos + n_neg)::DOUBLE AS frac_pos, n_neg / (n_pos + n_neg)::DOUBLE AS frac_neg,
  weight_pos / (weight_pos - weight_neg) AS weight_frac_pos,
  abs(weight_neg / (weight_pos - weight_neg)) AS weight_frac_neg
FROM (SELECT count(*) FILTER (score > 0) AS n_pos, count(*) FILTER (score <= 0) AS n_neg,
  sum(score) FILTER (score > 0) AS weight_pos, sum(score) FILTER (score <= 0) AS weight_neg
  FROM ranked)"""
add(
    "metric_weights",
    lambda spark, d: r6(measures.metric_weights(i.ranked(spark, d)), *_WEIGHTS),
    "SELECT n_pos, n_neg, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _WEIGHTS)
    + f" FROM ({_WEIGHTS_SQL})",
)
add(
    "row_scale_stats",
    lambda spark, d: r6(
        measures.row_scale_stats(i.dense_features(spark, d)),
        "value", "row_min", "row_max", "row_centre", "place",
    ),
    """
SELECT feature, sample, round(value, 6) AS value, round(lo, 6) AS row_min,
  round(hi, 6) AS row_max, round(mid, 6) AS row_centre, round(place, 6) AS place,
  least(floor(place * 12), 11)::BIGINT AS bucket
FROM (SELECT feature, sample, value, lo, hi, mid, coalesce(CASE WHEN value <= mid
    THEN 0.5 * (value - lo) / nullif(mid - lo, 0)
    ELSE 0.5 + 0.5 * (value - mid) / nullif(hi - mid, 0) END, 0) AS place
  FROM dense_features JOIN (SELECT feature, min(value) AS lo, max(value) AS hi,
    avg(value) AS mid FROM dense_features GROUP BY feature) s USING (feature))""",
)
_GLOBAL = "(SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mid FROM features) g"
add(
    "matrix_scale_stats",
    lambda spark, d: r6(measures.matrix_scale_stats(i.features(spark, d)), "min", "max", "mean"),
    f"SELECT round(lo, 6) AS min, round(hi, 6) AS max, round(mid, 6) AS mean FROM {_GLOBAL}",
)
add(
    "matrix_scale_edges",
    lambda spark, d: r6(measures.matrix_scale_edges(i.features(spark, d)), "edge", digits=4),
    f"""
SELECT slot, round(CASE WHEN slot <= 6 THEN lo + slot * (mid - lo) / 6
  ELSE mid + (slot - 6) * (hi - mid) / 6 END, 4) AS edge
FROM (SELECT unnest(range(1, 13)) AS slot), {_GLOBAL}""",
)
add(
    "matrix_scale_edges_log",
    lambda spark, d: r6(
        measures.matrix_scale_edges(i.features(spark, d), log=True), "edge", digits=4
    ),
    f"""
SELECT slot, round(exp(slot * ln(hi - lo + 1) / 12) + lo - 1, 4) AS edge
FROM (SELECT unnest(range(1, 13)) AS slot), {_GLOBAL}""",
)

# ---- ranking ----------------------------------------------------------------


def _rank_features(**options):
    def query(spark, d):
        scored = metrics.class_metric(
            "signal_to_noise", i.features(spark, d), i.side_labels(spark, d)
        )
        return r6(rank.rank_features(scored, **options).select("feature", "score", "rank"), "score")

    return query


_S2N = f"({_class_sql(_FORMS['signal_to_noise']).replace('6) AS score', '15) AS score')}) s"
add(
    "rank_features",
    _rank_features(),
    f"""
SELECT feature, round(score, 6) AS score,
  row_number() OVER (ORDER BY score DESC, row_idx) - 1 AS rank FROM {_S2N}""",
)
add(
    "rank_features_absolute",
    _rank_features(mode="absolute", ascending=True),
    f"""
SELECT feature, round(score, 6) AS score,
  row_number() OVER (ORDER BY abs(score), row_idx) - 1 AS rank FROM {_S2N}""",
)
add(
    "rank_scores",
    lambda spark, d: i.ranked(spark, d),
    "SELECT feature, score, rank FROM ranked",
)
add(
    "sub_ranking",
    lambda spark, d: rank.sub_ranking(
        i.ranked(spark, d), i.part_sets(spark, d).filter("set_name = 'TYPE_PROMO'")
    ).select("feature", "score", "rank"),
    """
SELECT feature, score, row_number() OVER (ORDER BY rank) - 1 AS rank FROM ranked
WHERE feature IN (SELECT member FROM part_sets WHERE set_name = 'TYPE_PROMO')""",
)
_ENDS = """
SELECT feature, score, rank, 'top' AS side, rank + 1 AS position FROM ranked WHERE rank < {k}
UNION ALL SELECT feature, score, rank, 'bottom', n - rank
FROM ranked, (SELECT count(*) AS n FROM ranked) c WHERE rank >= n - {k}"""
add(
    "top_bottom_k",
    lambda spark, d: rank.top_bottom_k(i.ranked(spark, d), 50),
    _ENDS.format(k=50),
)
add(
    "zero_crossing_rank",
    lambda spark, d: rank.zero_crossing_rank(i.ranked(spark, d)),
    "SELECT min(rank) + 1 AS zero_crossing_rank FROM ranked WHERE score <= 0",
)


def _marker_cells(spark, d):
    """Cells and labels, made once for all steps that read them; a row's cells lie together."""
    features = i.features(spark, d).drop("sample_idx")
    features = cut(spread(features, tasks_for(features), "row_idx", "feature"))
    labels = sent(i.side_labels(spark, d))
    release(spark)
    return clean.omit_features_without_class_data(features, labels), labels


def _lists(cells, labels):
    """Both ends of every permuted list; the markers need no more of them."""
    scores = label_null.scores_by_labels(cells, labels, PERMS, ends=reports.MARKERS)
    return nulls.permuted_lists(scores, ends=reports.MARKERS)


_MARKERS = reports.MARKERS
_MARKER_RUN = {
    **MATRIX_RUN,
    "perm_lists": "SELECT perm, feature, score, rank FROM run_lists",
    "real_scores": "SELECT feature, rank AS row_idx, score FROM ranked",
}
_LEVELS = " UNION ALL ".join(
    f"SELECT {v}::DOUBLE AS level, {reports.level_index(v, PERMS, False)} AS up,"
    f" {reports.level_index(v, PERMS, True)} AS down"
    for v in reports.MARKER_LEVELS
)
_MARKER_SQL = f"""
SELECT position, w.level, max(CASE WHEN side = 'top' AND i = w.up THEN score END) AS up,
  max(CASE WHEN side = 'bottom' AND i = w.down THEN score END) AS down
FROM (
  SELECT side, position, score,
    row_number() OVER (PARTITION BY side, position ORDER BY score DESC, perm) - 1 AS i
  FROM (
    SELECT perm, 'top' AS side, rank + 1 AS position, score FROM perm_lists WHERE rank < {_MARKERS}
    UNION ALL
    SELECT perm, 'bottom', n - rank, score
    FROM perm_lists JOIN (SELECT perm, count(*) AS n FROM perm_lists GROUP BY perm) c USING (perm)
    WHERE rank >= n - {_MARKERS}
  )
), ({_LEVELS}) w
GROUP BY position, w.level"""
add(
    "marker_significance",
    lambda spark, d: r6(
        reports.marker_significance(_lists(*_marker_cells(spark, d)), PERMS, _MARKERS), "up", "down"
    ),
    f"SELECT position, level, round(up, 6) AS up, round(down, 6) AS down FROM ({_MARKER_SQL})",
    **_MARKER_RUN,
)


def _butterfly(spark, d):
    cells, labels = _marker_cells(spark, d)
    real = rank.rank_features(metrics.class_metric("signal_to_noise", cells, labels))
    sig = reports.marker_significance(_lists(cells, labels), PERMS, _MARKERS)
    return r6(
        reports.butterfly_table(real, sig, _MARKERS), "observed_up", "observed_down", "up", "down"
    )


add(
    "butterfly_table",
    _butterfly,
    f"""
SELECT m.position, m.level, round(o.up, 6) AS observed_up, round(o.down, 6) AS observed_down,
  round(m.up, 6) AS up, round(m.down, 6) AS down
FROM ({_MARKER_SQL}) m
JOIN (
  SELECT position, max(CASE WHEN side = 'top' THEN score END) AS up,
    max(CASE WHEN side = 'bottom' THEN score END) AS down
  FROM (
    SELECT 'top' AS side, row_number() OVER (ORDER BY score DESC, row_idx) AS position, score
    FROM real_scores
    UNION ALL
    SELECT 'bottom', row_number() OVER (ORDER BY score, row_idx DESC), score FROM real_scores
  ) GROUP BY position
) o ON o.position = m.position""",
    **_MARKER_RUN,
)

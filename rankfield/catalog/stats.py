"""Enrichment statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import enrich, leading, nulls, permute, sets, signif
from ..operators.rank import sort_results_by_nes
from ..session import cut
from .base import NUDGE, PERMS, SEED, Entry, r6, r6_fraction, sql

ENTRIES: dict[str, Entry] = {}


def add(name: str, query, twin: str | None) -> None:
    ENTRIES[name] = Entry(query, sql(twin) if twin else None)


class Parts(NamedTuple):
    ranked: DataFrame
    kept: DataFrame
    hits: DataFrame
    es: DataFrame


def kept_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ranked = i.ranked(spark, d)
    return ranked, cut(sets.filter_sets_by_size(i.part_sets(spark, d), ranked))


def edge_parts(spark: SparkSession, d: str, scheme: str = "weighted") -> Parts:
    """List, sets, hits and ES of the ranked-list run."""
    ranked, kept = kept_sets(spark, d)
    hits = cut(enrich.hits(ranked, kept, scheme))
    es = enrich.score_at(enrich.pick_extreme(hits, scheme), ranked)
    return Parts(ranked, kept, hits, es)


class Scored(NamedTuple):
    parts: Parts
    es: DataFrame
    null_es: DataFrame


def scored(spark: SparkSession, d: str) -> Scored:
    parts = edge_parts(spark, d)
    null_es = nulls.null_by_sets(parts.ranked, parts.kept, PERMS, SEED)
    return Scored(parts, cut(parts.es), cut(null_es))


def results(spark: SparkSession, d: str) -> tuple[Parts, DataFrame, DataFrame]:
    run = scored(spark, d)
    return run.parts, signif.significance(run.es, run.null_es), run.null_es


# ---- sets -------------------------------------------------------------------

add(
    "filter_sets_by_size",
    lambda spark, d: kept_sets(spark, d)[1].select("set_name", "member"),
    "SELECT set_name, member FROM kept",
)
add(
    "set_size_report",
    lambda spark, d: sets.set_size_report(i.part_sets(spark, d), kept_sets(spark, d)[1]),
    """
SELECT s.set_name, count(*) AS original_size, any_value(k.size) AS restricted_size,
  CASE WHEN any_value(k.size) IS NULL THEN 'Rejected!' ELSE '' END AS status
FROM part_sets s LEFT JOIN kept_sizes k USING (set_name) GROUP BY s.set_name""",
)
add(
    "membership_index",
    lambda spark, d: sets.membership_index(i.ranked(spark, d), i.part_sets(spark, d)),
    "SELECT r.feature, s.set_name FROM ranked r JOIN part_sets s ON s.member = r.feature",
)
add(
    "count_members",
    lambda spark, d: sets.count_members(
        i.part_sets(spark, d), i.ranked(spark, d).filter("score > 0")
    ),
    """
SELECT s.set_name, count(*) AS size, count(r.feature) AS n_present
FROM part_sets s LEFT JOIN ranked r ON r.feature = s.member AND r.score > 0
GROUP BY s.set_name""",
)

# ---- scoring schemes and ES -------------------------------------------------

# hit weight and total per scheme, over the kept sets; the twin walks every rank
_SCHEME_SQL = {
    "classic": ("1.0", "1.0", "0"),
    "weighted": ("abs(score)", "abs(score)", "0"),
    "weighted_p2": ("score * score", "score * score", "0"),
    "weighted_p1_5": (
        "pow(abs(score), 1.5)",
        "CASE WHEN score >= 0 THEN pow(abs(score), 1.5) ELSE 0 END",
        "CASE WHEN score >= 0 THEN 0 ELSE 1e-6 END",
    ),
}


def _walk(total: str, hit: str, fixed: str) -> str:
    return f"""(
SELECT set_name, size, rank, score, feature, hit,
  sum(CASE WHEN hit THEN h / nullif(total, 0) + fixed
           ELSE -1.0 / nullif(n_features - size, 0) END)
    OVER (PARTITION BY set_name ORDER BY rank) AS run,
  h / nullif(total, 0) + fixed AS weight
FROM (
  SELECT z.set_name, z.size, r.rank, r.score, r.feature, m.member IS NOT NULL AS hit,
    {hit} AS h, {fixed} AS fixed,
    sum(CASE WHEN m.member IS NOT NULL THEN {total} END) OVER (PARTITION BY z.set_name) AS total,
    (SELECT count(*) FROM ranked) AS n_features
  FROM kept_sizes z CROSS JOIN ranked r
  LEFT JOIN kept m ON m.set_name = z.set_name AND m.member = r.feature
)) w"""


_NAMES = {"weighted_p1_5": "weighted_p1.5"}
for _name, _forms in _SCHEME_SQL.items():
    _scheme = _NAMES.get(_name, _name)

    def _query(spark, d, scheme=_scheme):
        hits = edge_parts(spark, d, scheme).hits
        shown = hits.select("set_name", "hit_no", "rank", "weight", "running_es")
        return r6_fraction(shown, "weight", "running_es")

    add(
        f"score_{_name}",
        _query,
        f"""
SELECT set_name, row_number() OVER (PARTITION BY set_name ORDER BY rank) - 1 AS hit_no, rank,
  round(weight + {NUDGE}, 6) AS weight, round(run + {NUDGE}, 6) AS running_es
FROM {_walk(*_forms)} WHERE hit""",
    )

    def _es_query(spark, d, scheme=_scheme):
        es = edge_parts(spark, d, scheme).es
        return r6_fraction(es.select("set_name", "size", "es", "rank_at_max", "score_at_max"), "es")

    add(
        "enrichment_score" if _name == "weighted" else f"enrichment_score_{_name}",
        _es_query,
        f"""
SELECT set_name, size, round(run + {NUDGE}, 6) AS es, rank AS rank_at_max, score AS score_at_max
FROM {_walk(*_forms)}
QUALIFY row_number() OVER (
  PARTITION BY set_name ORDER BY floor(abs(run) * 1e9 + 0.5) DESC, rank) = 1""",
    )

add(
    "rank_at_max",
    lambda spark, d: edge_parts(spark, d).es.select("set_name", "rank_at_max"),
    "SELECT set_name, rank_at_max FROM es",
)
add(
    "score_at_max",
    lambda spark, d: edge_parts(spark, d).es.select("set_name", "score_at_max"),
    "SELECT set_name, score_at_max FROM es",
)
add(
    "running_es_profile",
    lambda spark, d: r6(enrich.running_es_profile(edge_parts(spark, d).hits), "running_es"),
    "SELECT set_name, hit_no, rank, round(running_es, 6) AS running_es FROM hits",
)


def _running_full(spark, d):
    parts = edge_parts(spark, d)
    return r6(enrich.running_es_full(parts.ranked, parts.hits, parts.kept), "running_es", digits=5)


add(
    "running_es_full",
    _running_full,
    "SELECT set_name, rank, round(run, 5) AS running_es FROM walk",
)

# ---- permutations -----------------------------------------------------------

add(
    "permute_labels",
    lambda spark, d: permute.permute_labels(i.vector_labels(spark, d), PERMS, SEED),
    "SELECT perm, sample, class_idx FROM shuffled",
)
_PERM = f"(SELECT unnest(range({PERMS})) AS perm) p"
add(
    "permute_numeric_profile",
    lambda spark, d: permute.permute_numeric_profile(i.side_labels(spark, d), PERMS, SEED),
    f"""
SELECT a.perm, a.sample, b.num_value
FROM (SELECT p.perm, l.sample, row_number() OVER (PARTITION BY p.perm
        ORDER BY md5('{SEED}:' || p.perm || ':' || l.sample), l.sample) AS spot
      FROM side_labels l, {_PERM}) a
JOIN (SELECT num_value, row_number() OVER (ORDER BY position) AS spot FROM side_labels) b
  ON a.spot = b.spot""",
)
_BALANCED = {
    "balance_class0": "n0 // 2",
    "equalize_and_balance": "n0 - n0 // 2",
    "balance_class1": "n0 - n1 // 2",
}
for _kind, _stay in _BALANCED.items():
    # the vectors' classes are near even, so every kind is possible there
    def _balanced(spark, d, kind=_kind):
        return permute.permute_labels(i.vector_labels(spark, d), PERMS, SEED, kind)

    add(
        "permute_labels_balanced" if _kind == "balance_class0" else f"permute_labels_{_kind}",
        _balanced,
        f"""
SELECT perm, sample, CASE WHEN spot <= CASE WHEN class_idx = 0 THEN {_stay}
    ELSE n0 - ({_stay}) END THEN 0 ELSE 1 END AS class_idx
FROM (SELECT p.perm, l.sample, l.class_idx, row_number() OVER (PARTITION BY p.perm, l.class_idx
        ORDER BY md5('{SEED}:' || p.perm || ':' || l.sample), l.sample) AS spot
      FROM vector_labels l, {_PERM}),
  (SELECT count(*) FILTER (class_idx = 0) AS n0, count(*) FILTER (class_idx = 1) AS n1
   FROM vector_labels)""",
    )


def _random_sets(spark, d):
    ranked, kept = kept_sets(spark, d)
    return permute.random_sets(ranked, kept, PERMS, SEED)


add(
    "random_sets",
    _random_sets,
    """
SELECT d.set_name, d.perm, r.feature AS member FROM drawn d JOIN ranked r USING (rank)""",
)


def _null_by_sets(path):
    def query(spark, d):
        ranked, kept = kept_sets(spark, d)
        return r6(path(ranked, kept, PERMS, SEED), "es")

    return query


_NULL_SQL = "SELECT set_name, perm, round(es, 6) AS es FROM null_es"
add("null_es_by_random_sets", _null_by_sets(nulls.null_by_sets), _NULL_SQL)
add("null_es_by_random_sets_plan", _null_by_sets(nulls.null_by_sets_plan), _NULL_SQL)

_LABEL_NULL = """
SELECT set_name, perm, round(v, 6) AS es FROM (
  SELECT set_name, perm, rank - 1 AS spot,
    (reached - w) / total - (rank - k) / (n - size)::DOUBLE AS v FROM label_hits
  UNION ALL
  SELECT set_name, perm, rank, reached / total - (rank - k) / (n - size)::DOUBLE FROM label_hits
)
QUALIFY row_number() OVER (
  PARTITION BY set_name, perm ORDER BY floor(abs(v) * 1e9 + 0.5) DESC, spot) = 1"""


def _null_by_labels(path):
    return lambda spark, d: r6(
        path(
            i.dense_features(spark, d),
            i.vector_labels(spark, d),
            i.dimension_sets(spark, d),
            PERMS,
            SEED,
        ).select("set_name", "perm", "es"),
        "es",
    )


add("null_es_by_label_permutation", _null_by_labels(nulls.null_by_labels), _LABEL_NULL)
add("null_es_by_label_permutation_plan", _null_by_labels(nulls.null_by_labels_plan), _LABEL_NULL)

# ---- significance -----------------------------------------------------------


def _normalized(mode: str, null: bool):
    def query(spark, d):
        run = scored(spark, d)
        real, rnd = signif.normalize(run.es, run.null_es, mode)
        if null:
            return r6(rnd.select("set_name", "perm", "nes"), "nes")
        return r6(real.select("set_name", "es", "nes"), "es", "nes")

    return query


add(
    "normalize_mean_by_sign",
    _normalized("meandiv", False),
    "SELECT set_name, round(es, 6) AS es, round(nes, 6) AS nes FROM nes",
)
add(
    "normalize_null_mean_by_sign",
    _normalized("meandiv", True),
    "SELECT set_name, perm, round(nes, 6) AS nes FROM null_nes",
)
add(
    "normalize_none",
    _normalized("none", False),
    "SELECT set_name, round(es, 6) AS es, round(es, 6) AS nes FROM es",
)


def _nominal(column: str):
    def query(spark, d):
        run = scored(spark, d)
        return r6(signif.nominal_p(run.es, run.null_es).select("set_name", column), column)

    return query


add("nominal_p", _nominal("np"), "SELECT set_name, round(np, 6) AS np FROM pvals")
add("nominal_p_all", _nominal("np_all"), "SELECT set_name, round(np_all, 6) AS np_all FROM pvals")


def _fdr(spark, d):
    run = scored(spark, d)
    return r6(
        signif.fdr(*signif.normalize(run.es, run.null_es)), "fdr_num", "fdr_den", "fdr"
    )


add(
    "fdr_q",
    _fdr,
    """
SELECT set_name, round(fdr_num, 6) AS fdr_num,
  CASE WHEN fdr_num IS NOT NULL THEN round(fdr_den, 6) END AS fdr_den,
  CASE WHEN fdr_num IS NOT NULL THEN round(fdr, 6) END AS fdr FROM fdrs""",
)


def _fwer(spark, d):
    run = scored(spark, d)
    return r6(signif.fwer(*signif.normalize(run.es, run.null_es)), "fwer")


add("fwer_p", _fwer, "SELECT set_name, round(fwer, 6) AS fwer FROM fwers")
add(
    "count_significant",
    lambda spark, d: signif.count_significant(results(spark, d)[1]),
    """
SELECT CASE WHEN es > 0 THEN 'pos' ELSE 'neg' END AS side, count(*) AS n_sets,
  count(*) FILTER (np <= 0.01) AS np_01, count(*) FILTER (np <= 0.05) AS np_05,
  count(*) FILTER (fdr <= 0.25) AS fdr_25
FROM results WHERE es <> 0 GROUP BY 1""",
)


def _validate(spark, d):
    run = scored(spark, d)
    return signif.validate_results(run.es, run.null_es)


add(
    "validate_results",
    _validate,
    """
SELECT 'non_empty' AS "check", (count(*) = 0)::BIGINT AS n_bad, count(*) > 0 AS ok FROM es
UNION ALL
SELECT 'unique_names', count(*), count(*) = 0
FROM (SELECT set_name FROM es GROUP BY set_name HAVING count(*) > 1)
UNION ALL
SELECT 'same_permutations', count(*), count(*) = 0
FROM (SELECT e.set_name FROM es e LEFT JOIN null_es n USING (set_name)
      GROUP BY e.set_name HAVING count(n.perm) < 20)""",
)


def _sorted(spark, d):
    run = scored(spark, d)
    real, _ = signif.normalize(run.es, run.null_es)
    return r6(sort_results_by_nes(real).select("position", "set_name", "nes"), "nes")


add(
    "sort_results_by_nes",
    _sorted,
    """
SELECT row_number() OVER (ORDER BY nes DESC NULLS LAST, set_name) - 1 AS position, set_name,
  round(nes, 6) AS nes FROM nes""",
)


def _edge(spark, d):
    parts = edge_parts(spark, d)
    return leading.leading_edge_members(parts.hits, parts.es)


add("leading_edge_members", _edge, "SELECT set_name, feature, rank, score FROM edge")


def _edge_stats(spark, d):
    parts = edge_parts(spark, d)
    return r6(
        leading.leading_edge_stats(parts.hits, parts.es),
        "tag_fraction", "list_fraction", "signal_strength",
    )


add(
    "leading_edge_stats",
    _edge_stats,
    """
SELECT set_name, n_edge, peak_rank, round(tag_fraction, 6) AS tag_fraction,
  round(list_fraction, 6) AS list_fraction, round(signal_strength, 6) AS signal_strength
FROM edge_stats""",
)

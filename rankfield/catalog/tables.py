"""Report tables and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import leading, reports
from ..plans import runs
from ..session import scratch_path
from ..sources import writers
from .base import COLLAPSED_RUN, MATRIX_RUN, NUDGE, PARTS, PERMS, SEED, Entry, r6, r6_fraction, sql
from .stats import edge_parts, results, scored

ENTRIES: dict[str, Entry] = {}


def add(name: str, query, twin: str | None, **replaced: str) -> None:
    ENTRIES[name] = Entry(query, sql(twin, **replaced) if twin else None)


def add_complete(name: str, query, twin: str) -> None:
    """A twin that brings its own parts."""
    ENTRIES[name] = Entry(query, twin)


def _report(text: bool):
    def query(spark, d):
        parts, res, _ = results(spark, d)
        stats = leading.leading_edge_stats(parts.hits, parts.es)
        out = reports.enrichment_report(res, stats)
        if text:
            return out.select("side", "set_name", "leading_edge")
        return out.drop("leading_edge")

    return query


_SIDED = """(
SELECT 'pos' AS side, *, row_number() OVER (ORDER BY nes DESC NULLS LAST, set_name) - 1 AS position
FROM results WHERE es >= 0
UNION ALL
SELECT 'neg', *, row_number() OVER (ORDER BY nes ASC NULLS LAST, set_name) - 1
FROM results WHERE es <= 0) r"""
add(
    "enrichment_report",
    _report(False),
    f"""
SELECT r.side, r.position, r.set_name, r.size, round(r.es, 2) AS es, round(r.nes, 2) AS nes,
  round(r.np, 3) AS np, round(r.fdr, 3) AS fdr, round(r.fwer, 3) AS fwer,
  s.peak_rank AS rank_at_max
FROM {_SIDED} JOIN edge_stats s USING (set_name)""",
)
add(
    "enrichment_report_text",
    _report(True),
    f"""
SELECT r.side, r.set_name, printf('tags=%d%%, list=%d%%, signal=%d%%',
  floor(s.tag_fraction * 100 + 0.5)::BIGINT, floor(s.list_fraction * 100 + 0.5)::BIGINT,
  floor(s.signal_strength * 100 + 0.5)::BIGINT) AS leading_edge
FROM {_SIDED} JOIN edge_stats s USING (set_name)""",
)


def _titles(spark, d):
    return i.id_map(spark, d).select(F.col("probe").alias("feature"), "title")


def _set_detail(spark, d):
    return reports.set_detail(edge_parts(spark, d).hits, _titles(spark, d))


add(
    "set_detail",
    _set_detail,
    """
SELECT h.set_name, h.hit_no, h.feature, h.rank, round(h.score, 3) AS score,
  round(h.running_es, 4) AS running_es,
  CASE WHEN CASE WHEN m.dev >= 0 THEN h.rank <= m.spot ELSE h.rank >= m.spot END
    THEN 'Yes' ELSE 'No' END AS core_enrichment, t.title
FROM hits h
JOIN (SELECT set_name, running_es AS dev, rank AS spot FROM hits
      QUALIFY row_number() OVER (PARTITION BY set_name
        ORDER BY floor(abs(running_es) * 1e9 + 0.5) DESC, sign(running_es) DESC, rank) = 1) m
  USING (set_name)
LEFT JOIN id_map t ON t.probe = h.feature""",
)


def _set_summary(spark, d):
    out = reports.set_summary(results(spark, d)[1], "WEST", "EAST")
    number = F.col("value").try_cast("double")
    return out.select(
        "set_name",
        "key",
        F.when(number.isNull(), F.col("value")).alias("text"),
        F.round(number, 6).alias("number"),
    )


add(
    "set_summary",
    _set_summary,
    """
SELECT set_name, 'up_in_class' AS key, CASE WHEN es >= 0 THEN 'WEST' ELSE 'EAST' END AS text,
  NULL::DOUBLE AS number FROM results
UNION ALL SELECT set_name, 'es', NULL, round(es, 6) FROM results
UNION ALL SELECT set_name, 'nes', NULL, round(nes, 6) FROM results
UNION ALL SELECT set_name, 'np', NULL, round(np, 6) FROM results
UNION ALL SELECT set_name, 'fdr', NULL, round(fdr, 6) FROM results
UNION ALL SELECT set_name, 'fwer', NULL, round(fwer, 6) FROM results""",
)
add(
    "ranked_feature_report",
    lambda spark, d: reports.ranked_feature_report(i.ranked(spark, d), _titles(spark, d)),
    """
SELECT r.rank, r.feature, m.title, r.score
FROM ranked r LEFT JOIN id_map m ON m.probe = r.feature""",
)


def _run_summary(spark, d):
    parts, res, _ = results(spark, d)
    out = reports.run_summary(res, parts.ranked, i.part_sets(spark, d), i.features(spark, d))
    return r6(out, "value")


_SIDE = "SELECT '{s}_{c}' AS key, count(*)::DOUBLE AS value FROM results WHERE es {o} 0{w}"
_COUNTS = {"n_sets": "", "np_01": " AND np <= 0.01", "np_05": " AND np <= 0.05", "fdr_25": " AND fdr <= 0.25"}
add(
    "run_summary",
    _run_summary,
    " UNION ALL ".join(
        _SIDE.format(s=s, c=c, o=o, w=w)
        for s, o in (("pos", ">"), ("neg", "<"))
        for c, w in _COUNTS.items()
    )
    + """
UNION ALL SELECT 'n_sets', count(*) FROM results
UNION ALL SELECT 'n_sets_filtered', count(DISTINCT set_name) FROM part_sets
  WHERE set_name NOT IN (SELECT set_name FROM results)
UNION ALL SELECT 'n_features', count(*) FROM ranked
UNION ALL SELECT 'n_native_features', count(DISTINCT feature) FROM features
UNION ALL SELECT 'n_pos', count(*) FROM ranked WHERE score > 0
UNION ALL SELECT 'n_neg', count(*) FROM ranked WHERE score <= 0
UNION ALL SELECT 'frac_pos', round(avg((score > 0)::INT), 6) FROM ranked
UNION ALL SELECT 'frac_neg', round(avg((score <= 0)::INT), 6) FROM ranked
UNION ALL SELECT 'weight_frac_pos',
  round(sum(score) FILTER (score > 0) / sum(abs(score)), 6) FROM ranked
UNION ALL SELECT 'weight_frac_neg',
  round(-sum(score) FILTER (score <= 0) / sum(abs(score)), 6) FROM ranked""",
)
add(
    "extreme_features_matrix",
    lambda spark, d: r6(
        reports.extreme_features_matrix(i.features(spark, d), i.ranked(spark, d)), "value"
    ),
    """
SELECT e.side, e.position, f.feature, f.sample, round(f.value, 6) AS value
FROM features f JOIN (
  SELECT feature, 'top' AS side, rank + 1 AS position FROM ranked WHERE rank < 50
  UNION ALL SELECT feature, 'bottom', n - rank
  FROM ranked, (SELECT count(*) AS n FROM ranked) c WHERE rank >= n - 50) e USING (feature)""",
)
add(
    "nes_vs_significance",
    lambda spark, d: r6(
        reports.nes_vs_significance(results(spark, d)[1]), "nes", "fdr", "np"
    ),
    """
SELECT set_name, round(nes, 6) AS nes, round(fdr, 6) AS fdr, round(np, 6) AS np FROM results""",
)
add(
    "es_histogram",
    lambda spark, d: r6(reports.es_histogram(edge_parts(spark, d).es), "bin_start"),
    """
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_start, count(*) AS n
FROM (SELECT lo, hi, least(floor((es - lo) / (hi - lo) * 20), 19)::BIGINT AS bin
      FROM es, (SELECT min(es) AS lo, max(es) AS hi FROM es) x)
GROUP BY bin, lo, hi""",
)
add(
    "null_es_histogram",
    lambda spark, d: r6(
        reports.null_es_histogram(scored(spark, d).null_es), "bin_start", "positive_share"
    ),
    """
SELECT set_name, bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_start, count(*) AS n,
  round(share, 6) AS positive_share
FROM (SELECT set_name, lo, hi, share, least(floor((es - lo) / (hi - lo) * 20), 19)::BIGINT AS bin
      FROM null_es JOIN (SELECT set_name, min(es) AS lo, max(es) AS hi,
        avg((es >= 0)::INT) AS share FROM null_es GROUP BY set_name) x USING (set_name))
GROUP BY set_name, bin, lo, hi, share""",
)
add(
    "ranked_list_bins",
    lambda spark, d: r6_fraction(reports.ranked_list_bins(i.ranked(spark, d)), "mean_score"),
    f"""
SELECT side, floor(((spot + 1) * 100 - 1) / n::DOUBLE)::BIGINT AS bin,
  round(avg(score) + {NUDGE}, 6) AS mean_score, count(*) AS n
FROM (
  SELECT side, score, row_number() OVER (PARTITION BY side ORDER BY rank) - 1 AS spot,
    count(*) OVER (PARTITION BY side) AS n
  FROM (SELECT 'pos' AS side, * FROM ranked WHERE score >= 0
        UNION ALL SELECT 'neg', * FROM ranked WHERE score <= 0))
GROUP BY side, 2""",
)


def _warnings(spark, d):
    return reports.permutation_quality_warnings(i.side_labels(spark, d), results(spark, d)[1])


add(
    "permutation_quality_warnings",
    _warnings,
    """
SELECT w.warning, CASE w.warning WHEN 'class_a_small' THEN a < 7 WHEN 'class_b_small' THEN b < 7
  WHEN 'few_samples' THEN a + b < 14 WHEN 'non_finite_results' THEN bad
  ELSE sets = 1 END AS applies
FROM (SELECT unnest(['class_a_small', 'class_b_small', 'few_samples', 'non_finite_results',
        'single_set']) AS warning) w,
  (SELECT count(*) FILTER (class_idx = 0) AS a, count(*) FILTER (class_idx = 1) AS b
   FROM side_labels),
  (SELECT count(*) AS sets, bool_or(es IS NULL OR nes IS NULL OR np IS NULL OR fdr IS NULL
     OR fwer IS NULL) AS bad FROM results)""",
)

# ---- whole runs -------------------------------------------------------------
# On large tables every set of parts may exceed the size limit; the runs are empty then, as their twins are.

_NUMBERS = ("es", "nes", "np", "fdr", "fwer")
_RESULT = """
SELECT set_name, size, round(es, 6) AS es, rank_at_max, round(nes, 6) AS nes, round(np, 6) AS np,
  round(fdr, 6) AS fdr, round(fwer, 6) AS fwer FROM results"""


def _shape(run: runs.Run):
    cols = ("set_name", "size", "es", "rank_at_max", "nes", "np", "fdr", "fwer")
    return r6(run.results.select(*cols), *_NUMBERS)


def enrich_ranked(spark, d, nperm: int = PERMS):
    return runs.enrich_ranked(i.ranked(spark, d), i.part_sets(spark, d), nperm=nperm, seed=SEED, empty_ok=True)


add("enrich_ranked", lambda spark, d: _shape(enrich_ranked(spark, d)), _RESULT)


def _enrich_lists(spark, d):
    run = runs.enrich_lists(i.flag_ranked(spark, d), i.part_sets(spark, d), nperm=PERMS, seed=SEED, empty_ok=True)
    cols = ("list_id", "set_name", "size", "es", "rank_at_max", "nes", "np", "fdr", "fwer")
    return r6(run.results.select(*cols), *_NUMBERS)


def _one_list(flag: str) -> str:
    """The run of one list: its scores, and random streams named after it."""
    scores = PARTS["scores"].replace(
        "FROM lineitem", f"FROM lineitem WHERE l_returnflag = '{flag}'"
    )
    drawn = PARTS["drawn"].replace(f"'{SEED}:' ||", f"'{SEED}:{flag}:' ||")
    body = sql(_RESULT, scores=scores, drawn=drawn)
    return f"SELECT '{flag}' AS list_id, * FROM ({body})"


add_complete("enrich_lists", _enrich_lists, " UNION ALL ".join(_one_list(f) for f in ("A", "N", "R")))


def enrich_matrix(spark, d, nperm: int = PERMS, **options):
    return runs.enrich_matrix(
        i.features(spark, d),
        i.side_labels(spark, d),
        i.part_sets(spark, d),
        nperm=nperm,
        seed=SEED,
        empty_ok=True,
        **options,
    )


add("enrich_matrix", lambda spark, d: _shape(enrich_matrix(spark, d)), _RESULT, **MATRIX_RUN)


def _matrix_collapsed(spark, d):
    """Probes collapsed to brand/size symbols, sets of symbols by name word."""
    run = runs.enrich_matrix(
        i.features(spark, d),
        i.side_labels(spark, d),
        i.symbol_sets(spark, d),
        i.id_map(spark, d),
        collapse_choice="Collapse",
        permute="gene_set",
        set_max=100_000,
        nperm=PERMS,
        seed=SEED,
        empty_ok=True,
    )
    return _shape(run)


add("enrich_matrix_collapsed", _matrix_collapsed, _RESULT, **COLLAPSED_RUN)
add(
    "collapse_dataset",
    lambda spark, d: r6(
        runs.collapse_dataset(i.features(spark, d), i.id_map(spark, d), "max")[0].select(
            "feature", "title", "sample", "value"
        ),
        "value",
    ),
    """
SELECT m.symbol AS feature, t.title, f.sample, round(max(f.value), 6) AS value
FROM features f JOIN id_map m ON m.probe = f.feature
JOIN (SELECT m.symbol, arg_min(m.title, f.row_idx) AS title
      FROM (SELECT DISTINCT feature, row_idx FROM features) f
      JOIN id_map m ON m.probe = f.feature WHERE m.symbol <> '' GROUP BY m.symbol) t
  ON t.symbol = m.symbol
WHERE m.symbol <> '' GROUP BY m.symbol, t.title, f.sample""",
)
add(
    "map_sets",
    lambda spark, d: runs.map_sets(i.symbol_sets(spark, d), i.id_map(spark, d))[0],
    """
SELECT DISTINCT s.set_name, m.probe AS member
FROM symbol_sets s JOIN id_map m ON m.symbol = s.member""",
)


def _leading_edge(spark, d):
    run = enrich_ranked(spark, d)
    chosen = run.results.filter("es > 0").select("set_name")
    out = runs.leading_edge(run, chosen)
    return out["frequency"]


add(
    "leading_edge",
    _leading_edge,
    """
SELECT feature AS member, count(*) AS n_sets FROM edge JOIN es USING (set_name)
WHERE es.es > 0 GROUP BY feature""",
)


def _stored_leading_edge(spark, d):
    """The run is saved, loaded again and analysed from its tables alone."""
    path = scratch_path(spark, "run")
    enrich_ranked(spark, d).save(path)
    run = runs.load_run(spark, path)
    chosen = run.results.filter("es > 0").select("set_name")
    return runs.leading_edge(run, chosen)["members"].select("set_name", "member")


_STORED_EDGE = "SELECT set_name, feature AS member FROM edge JOIN es USING (set_name) WHERE es.es > 0"
add("leading_edge_of_stored_run", _stored_leading_edge, _STORED_EDGE)


def _document_leading_edge(spark, d):
    """The run is written as a result document, and analysed from it and the list alone."""
    run = enrich_ranked(spark, d)
    path = scratch_path(spark, "document")
    writers.write_results_xml(reports.results_with_arrays(run), path, {"METRIC": "None", "NUM_PERMS": str(PERMS)})
    again = runs.run_of_document(spark, path, run.ranked, empty_ok=True)
    chosen = again.results.filter("es > 0").select("set_name")
    return runs.leading_edge(again, chosen)["members"].select("set_name", "member")


add("leading_edge_of_result_document", _document_leading_edge, _STORED_EDGE)


def _summary_of_run(spark, d):
    """What a run says of itself, its warnings included."""
    run = enrich_ranked(spark, d)
    return r6(run.summary(i.part_sets(spark, d), i.features(spark, d)), "value").filter("key LIKE 'n\\_%' OR key LIKE 'warning\\_%'")


add(
    "run_summary_with_warnings",
    _summary_of_run,
    """
SELECT 'n_sets' AS key, count(*)::DOUBLE AS value FROM es
UNION ALL SELECT 'n_sets_filtered', (SELECT count(DISTINCT set_name) FROM part_sets) - count(*)::DOUBLE FROM es
UNION ALL SELECT 'n_features', count(*)::DOUBLE FROM ranked
UNION ALL SELECT 'n_native_features', count(DISTINCT feature)::DOUBLE FROM features
UNION ALL SELECT 'n_pos', count(*)::DOUBLE FROM ranked WHERE score >= 0
UNION ALL SELECT 'n_neg', count(*)::DOUBLE FROM ranked WHERE score < 0
UNION ALL SELECT 'warning_' || unnest(['class_a_small', 'class_b_small', 'few_samples', 'non_finite_results']), 0.0
UNION ALL SELECT 'warning_single_set', (count(*) = 1)::INT::DOUBLE FROM es""",
)

"""Set algebra and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import overlap
from .base import Entry, r6, sql
from .stats import edge_parts, results

ENTRIES: dict[str, Entry] = {}


def add(name: str, query, twin: str | None) -> None:
    ENTRIES[name] = Entry(query, sql(twin) if twin else None)


def _union(spark, d):
    parts = i.part_sets(spark, d)
    probes = i.id_map(spark, d).select(F.col("probe").alias("feature"))
    rows = i.dense_features(spark, d).select("feature")
    return overlap.union_collections(
        parts.filter("collection = 'brand'"),
        parts.filter("collection <> 'brand'"),
        i.dimension_sets(spark, d),
        overlap.features_as_set(rows, "MATRIX_ROWS"),
        overlap.features_as_set(probes, "PROBES"),
    )


add(
    "union_collections",
    _union,
    """
SELECT set_name, member FROM part_sets
UNION ALL SELECT set_name, member FROM dimension_sets
UNION ALL SELECT DISTINCT 'MATRIX_ROWS', feature FROM dense_features
UNION ALL SELECT 'PROBES', probe FROM id_map""",
)
add(
    "combine_into_one",
    lambda spark, d: overlap.combine_into_one(i.part_sets(spark, d)),
    "SELECT DISTINCT member FROM part_sets",
)


def _line_sets(spark, d):
    """Suppliers as sets of the parts on their lines, repeats included."""
    return i.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("set_name"),
        F.concat(F.lit("P"), "l_partkey").alias("member"),
        F.col("l_orderkey").alias("member_pos"),
    )


add(
    "dedupe_members",
    lambda spark, d: overlap.dedupe_members(_line_sets(spark, d)),
    """
SELECT 'S' || l_suppkey AS set_name, 'P' || l_partkey AS member, min(l_orderkey) AS member_pos
FROM lineitem GROUP BY 1, 2""",
)
add(
    "explode_collection",
    lambda spark, d: overlap.explode_collection(i.part_sets(spark, d), "type_Promo").select(
        "set_name", "member"
    ),
    "SELECT set_name, member FROM part_sets WHERE set_name = 'TYPE_PROMO'",
)
add(
    "intersection_size",
    lambda spark, d: overlap.intersection_size(i.part_sets(spark, d)),
    "SELECT a, b, inter FROM pair_counts WHERE a < b",
)
_ALL = """
(SELECT x.set_name AS a, y.set_name AS b, x.n AS n_a, y.n AS n_b,
   coalesce(p.inter, 0) AS inter, x.n + y.n - coalesce(p.inter, 0) AS union_size,
   coalesce(p.jaccard, 0) AS jaccard
 FROM (SELECT set_name, count(*) AS n FROM part_sets GROUP BY set_name) x
 CROSS JOIN (SELECT set_name, count(*) AS n FROM part_sets GROUP BY set_name) y
 LEFT JOIN pair_counts p ON p.a = x.set_name AND p.b = y.set_name) m"""
add(
    "union_size",
    lambda spark, d: overlap.union_size(i.part_sets(spark, d)),
    f"SELECT a, b, union_size FROM {_ALL} WHERE a < b AND inter > 0",
)
add(
    "overlap_fraction",
    lambda spark, d: r6(overlap.overlap_fraction(i.part_sets(spark, d)), "overlap_fraction"),
    f"SELECT a, b, round(inter / n_a::DOUBLE, 6) AS overlap_fraction FROM {_ALL} WHERE inter > 0",
)
add(
    "jaccard_matrix",
    lambda spark, d: r6(overlap.jaccard_matrix(i.part_sets(spark, d)), "jaccard"),
    f"SELECT a, b, round(jaccard, 6) AS jaccard FROM {_ALL} WHERE inter > 0",
)
add(
    "jaccard_mean",
    lambda spark, d: r6(overlap.jaccard_mean(i.part_sets(spark, d)), "jaccard_mean"),
    f"SELECT round(avg(jaccard), 6) AS jaccard_mean FROM {_ALL}",
)
add(
    "jaccard_distribution",
    lambda spark, d: overlap.jaccard_distribution(i.part_sets(spark, d)),
    f"SELECT round(jaccard, 6) AS jaccard, count(*) AS n_pairs FROM {_ALL} WHERE a < b GROUP BY 1",
)
add(
    "jaccard_histogram",
    lambda spark, d: r6(overlap.jaccard_histogram(i.part_sets(spark, d)), "bin_start"),
    f"""
SELECT floor(jaccard / 0.02 + 1e-9)::BIGINT AS bin, count(*) AS n_pairs,
  round(floor(jaccard / 0.02 + 1e-9) * 0.02, 6) AS bin_start
FROM {_ALL} WHERE a < b GROUP BY 1, 3""",
)
add(
    "member_frequency",
    lambda spark, d: overlap.member_frequency(i.part_sets(spark, d)),
    "SELECT member, count(*) AS n_sets FROM part_sets GROUP BY member",
)
add(
    "co_member_pairs",
    lambda spark, d: overlap.co_member_pairs(i.part_sets(spark, d)),
    """
SELECT count(*) AS distinct_pairs,
  (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (
     SELECT count(*) AS n FROM part_sets GROUP BY set_name)) AS possible_pairs
FROM (SELECT DISTINCT a.member_pos AS x, b.member_pos AS y
      FROM part_sets a JOIN part_sets b
        ON a.set_name = b.set_name AND a.member_pos < b.member_pos)""",
)
add(
    "collection_summary",
    lambda spark, d: r6(overlap.collection_summary(i.part_sets(spark, d)), "mean_size"),
    """
SELECT count(*) AS n_sets, max(n) AS max_size, min(n) AS min_size,
  round(avg(n), 6) AS mean_size, (SELECT count(DISTINCT member) FROM part_sets) AS n_members
FROM (SELECT count(*) AS n FROM part_sets GROUP BY set_name)""",
)
add(
    "incidence_matrix",
    lambda spark, d: overlap.incidence_matrix(i.part_sets(spark, d)),
    "SELECT DISTINCT set_name, member, 1 AS present FROM part_sets",
)
add(
    "score_incidence",
    lambda spark, d: overlap.score_incidence(i.part_sets(spark, d), i.ranked(spark, d)),
    """
SELECT s.set_name, s.member, r.score
FROM part_sets s JOIN ranked r ON r.feature = s.member""",
)


def _edges(metric: str):
    def query(spark, d):
        parts, res, _ = results(spark, d)
        out = overlap.similarity_edges(
            parts.kept, res, metric=metric, p_cut=0.5, q_cut=1.0, cutoff=0.05
        )
        return r6(out, "similarity")

    return query


_EDGES = """
SELECT a.set_name AS a, b.set_name AS b, count(*) AS inter, x.size AS n_a, y.size AS n_b
FROM kept a JOIN kept b ON a.member = b.member AND a.set_name < b.set_name
JOIN kept_sizes x ON x.set_name = a.set_name JOIN kept_sizes y ON y.set_name = b.set_name
JOIN results ra ON ra.set_name = a.set_name AND ra.np <= 0.5 AND ra.fdr <= 1
JOIN results rb ON rb.set_name = b.set_name AND rb.np <= 0.5 AND rb.fdr <= 1
GROUP BY a.set_name, b.set_name, x.size, y.size"""
_SIMILAR = {
    "OVERLAP": "inter / least(n_a, n_b)::DOUBLE",
    "JACCARD": "inter / (n_a + n_b - inter)::DOUBLE",
    "COMBINED": "0.5 * inter / least(n_a, n_b) + 0.5 * inter / (n_a + n_b - inter)",
}
for _metric, _form in _SIMILAR.items():
    add(
        "similarity_edges" if _metric == "OVERLAP" else f"similarity_edges_{_metric.lower()}",
        _edges(_metric),
        f"""
SELECT a, b, inter, round({_form}, 6) AS similarity FROM ({_EDGES}) e
WHERE {_form} >= 0.05""",
    )


def _edge_analysis(spark, d):
    """Overlap of the leading edges: shared members per pair of sets."""
    from ..operators.leading import leading_edge_members

    parts = edge_parts(spark, d)
    edge = overlap.leading_edge_sets(leading_edge_members(parts.hits, parts.es))
    return r6(overlap.pair_overlap(edge).select("a", "b", "inter", "jaccard"), "jaccard")


add(
    "leading_edge_analysis",
    _edge_analysis,
    """
SELECT a.set_name AS a, b.set_name AS b, count(*) AS inter,
  round(count(*) / (x.n + y.n - count(*))::DOUBLE, 6) AS jaccard
FROM edge a JOIN edge b ON a.feature = b.feature AND a.set_name < b.set_name
JOIN (SELECT set_name, count(*) AS n FROM edge GROUP BY set_name) x ON x.set_name = a.set_name
JOIN (SELECT set_name, count(*) AS n FROM edge GROUP BY set_name) y ON y.set_name = b.set_name
GROUP BY a.set_name, b.set_name, x.n, y.n""",
)
_CORR = """
SELECT a, b, (m * inter - n_a * n_b)
  / nullif(sqrt((m * n_a - n_a * n_a)::DOUBLE * (m * n_b - n_b * n_b)::DOUBLE), 0) AS corr
FROM pair_counts, (SELECT count(DISTINCT member) AS m FROM part_sets) t WHERE a < b"""
add(
    "incidence_correlation",
    lambda spark, d: r6(overlap.incidence_correlation(i.part_sets(spark, d)), "corr"),
    f"SELECT a, b, round(corr, 6) AS corr FROM ({_CORR}) c",
)
_CUT = 0.05
add(
    "correlation_clusters",
    lambda spark, d: overlap.correlation_clusters(i.part_sets(spark, d), _CUT),
    f"""
SELECT s.set_name, coalesce(min(r.other), s.set_name) AS cluster
FROM (SELECT DISTINCT set_name FROM part_sets) s
LEFT JOIN (
  WITH RECURSIVE near AS MATERIALIZED (
    SELECT a AS x, b AS y FROM ({_CORR}) c WHERE corr >= {_CUT}
    UNION ALL SELECT b, a FROM ({_CORR}) c WHERE corr >= {_CUT}
  ),
  reach AS (
    SELECT x AS one, x AS other FROM near
    UNION
    SELECT r.one, n.y FROM reach r JOIN near n ON n.x = r.other
  )
  SELECT one, other FROM reach
) r ON r.one = s.set_name
GROUP BY s.set_name""",
)

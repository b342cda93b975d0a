"""SQL building blocks for the twins of the registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws

Query = Callable[[SparkSession, str], DataFrame]

SEED = 149
# Permutations of the registered queries.
PERMS = 1000


class Entry(NamedTuple):
    query: Query
    sql: str | None


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns]
    )


# Added before rounding where values are exact fractions, so that both engines
# round a tie the same way.
NUDGE = 1e-9


def r6_fraction(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        *[F.round(F.col(c) + NUDGE, 6).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def _mix_steps(source: str, columns: list[str]) -> str:
    """Nested selects applying the integer hash to each of ``columns``."""
    s0, s1, s2 = draws.SHIFTS
    m0, m1 = draws.MULTIPLIERS
    rest = "* EXCLUDE (" + ", ".join(columns) + ")"

    def step(inner: str, form: str) -> str:
        return (
            f"(SELECT {rest}, "
            + ", ".join(f"{form.format(c=c)} AS {c}" for c in columns)
            + f" FROM {inner})"
        )

    out = source
    out = step(out, f"xor({{c}}, {{c}} >> {s0})")
    out = step(out, f"(({{c}} * {m0}) & {draws.MASK})")
    out = step(out, f"xor({{c}}, {{c}} >> {s1})")
    out = step(out, f"(({{c}} * {m1}) & {draws.MASK})")
    return step(out, f"xor({{c}}, {{c}} >> {s2})")


_DRAW_SOURCE = f"""(
  SELECT set_name, size, perm, k, n_features,
    (b1 + k * {draws.STEP}) & {draws.MASK} AS h1,
    (b2 + k * {draws.STEP}) & {draws.MASK} AS h2
  FROM (
    SELECT s.set_name, s.size, p.perm, n.n_features,
      ('0x' || substr(md5('{SEED}:' || s.set_name || ':' || p.perm), 1, 8))::BIGINT AS b1,
      ('0x' || substr(md5('{SEED}:' || s.set_name || ':' || p.perm), 9, 8))::BIGINT AS b2
    FROM kept_sizes s, (SELECT unnest(range({PERMS})) AS perm) p,
      (SELECT count(*) AS n_features FROM ranked) n
  ), LATERAL (SELECT unnest(range(4 * size + 64)) AS k)
)"""

PARTS: dict[str, str] = {
    "features": """
SELECT l_partkey AS row_idx, 'P' || l_partkey AS feature, l_suppkey AS sample_idx,
  'S' || l_suppkey AS sample, sqrt(sum(l_extendedprice * (1 - l_discount))) AS value
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "order_features": """
SELECT o_orderkey AS row_idx, 'C' || o_custkey AS feature, o_orderpriority AS sample,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value
FROM orders""",
    "dense_features": """
SELECT (d - 1) AS row_idx, 'D' || (d - 1) AS feature, vec_id AS sample_idx,
  'V' || vec_id AS sample, embedding[d]::DOUBLE AS value
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS d)""",
    "region_labels": """
SELECT 'region' AS phenotype, 'S' || s_suppkey AS sample, s_suppkey AS position,
  r_name AS class_name, r_regionkey AS class_idx, s_acctbal AS num_value
FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
    "side_labels": """
SELECT 'side' AS phenotype, sample, position,
  CASE WHEN class_name IN ('AMERICA', 'EUROPE') THEN 'WEST' ELSE 'EAST' END AS class_name,
  CASE WHEN class_name IN ('AMERICA', 'EUROPE') THEN 0 ELSE 1 END AS class_idx, num_value
FROM region_labels""",
    "vector_labels": """
SELECT 'label' AS phenotype, 'V' || vec_id AS sample, vec_id AS position,
  CASE WHEN label < 5 THEN 'LOW' ELSE 'HIGH' END AS class_name,
  CASE WHEN label < 5 THEN 0 ELSE 1 END AS class_idx, label::DOUBLE AS num_value
FROM embeddings""",
    "scores": """
SELECT 'P' || l_partkey AS feature, l_partkey AS row_idx,
  round(avg(l_discount) - (SELECT avg(l_discount) FROM lineitem), 6) AS score
FROM lineitem GROUP BY l_partkey""",
    "ranked": """
SELECT feature, score, row_number() OVER (ORDER BY score DESC, row_idx) - 1 AS rank
FROM scores""",
    "order_ranked": """
SELECT 'C' || o_custkey AS feature, o_orderkey AS row_idx, o_totalprice AS score,
  row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank
FROM orders""",
    "part_sets": """
SELECT 'brand' AS collection, upper(replace(p_brand, '#', '_')) AS set_name,
  'P' || p_partkey AS member, p_partkey AS member_pos FROM part
UNION ALL
SELECT 'type', upper('TYPE_' || p_type), 'P' || p_partkey, p_partkey FROM part
UNION ALL
SELECT 'size', upper('SIZE_' || p_size), 'P' || p_partkey, p_partkey FROM part""",
    "dimension_sets": """
SELECT 'LABEL_' || label AS set_name, feature AS member, row_idx AS member_pos
FROM (SELECT e.label, f.feature, f.row_idx, round(avg(f.value), 9) AS m
      FROM dense_features f JOIN embeddings e ON f.sample_idx = e.vec_id
      GROUP BY e.label, f.feature, f.row_idx) a
JOIN (SELECT feature AS g, round(avg(value), 9) AS overall FROM dense_features GROUP BY feature) b
  ON a.feature = b.g
WHERE m > overall""",
    "id_map": """
SELECT 'parts' AS platform, 'P' || p_partkey AS probe,
  CASE WHEN starts_with(p_name, 'hot') THEN '' ELSE p_brand || '/' || p_size END AS symbol,
  p_name AS title, p_partkey AS line
FROM part""",
    "symbol_sets": """
SELECT DISTINCT upper(split_part(title, ' ', 1)) AS set_name, symbol AS member
FROM id_map WHERE symbol <> ''""",
    "kept": """
SELECT s.set_name, s.member
FROM part_sets s JOIN ranked r ON s.member = r.feature
WHERE s.set_name IN (SELECT set_name FROM part_sets GROUP BY set_name HAVING count(*) >= 15)
QUALIFY count(*) OVER (PARTITION BY s.set_name) BETWEEN 15 AND 500""",
    "kept_sizes": "SELECT set_name, count(*) AS size FROM kept GROUP BY set_name",
    # full scan over every rank of the list
    "walk": """
SELECT set_name, size, rank, score, feature, hit, n_features,
  sum(CASE WHEN hit THEN w / nullif(total, 0) ELSE -1.0 / nullif(n_features - size, 0) END)
    OVER (PARTITION BY set_name ORDER BY rank) AS run
FROM (
  SELECT z.set_name, z.size, r.rank, r.score, r.feature, m.member IS NOT NULL AS hit,
    abs(r.score) AS w, sum(CASE WHEN m.member IS NOT NULL THEN abs(r.score) END)
      OVER (PARTITION BY z.set_name) AS total,
    (SELECT count(*) FROM ranked) AS n_features
  FROM kept_sizes z CROSS JOIN ranked r
  LEFT JOIN kept m ON m.set_name = z.set_name AND m.member = r.feature
)""",
    "es": """
SELECT set_name, size, run AS es, rank AS rank_at_max, score AS score_at_max, n_features
FROM walk
QUALIFY row_number() OVER (
  PARTITION BY set_name ORDER BY floor(abs(run) * 1e9 + 0.5) DESC, rank) = 1""",
    "hits": """
SELECT set_name, feature, score, rank, run AS running_es, size AS n_hits, n_features,
  row_number() OVER (PARTITION BY set_name ORDER BY rank) - 1 AS hit_no
FROM walk WHERE hit""",
    "drawn": f"""
SELECT set_name, size, perm, rank FROM (
  SELECT set_name, size, perm, k, ((h1 >> 1) * 2147483648 + (h2 >> 1)) % n_features AS rank
  FROM {_mix_steps(_DRAW_SOURCE, ["h1", "h2"])}
)
GROUP BY set_name, size, perm, rank
QUALIFY row_number() OVER (PARTITION BY set_name, perm ORDER BY min(k)) <= size""",
    "null_hits": """
SELECT d.set_name, d.perm, d.size, d.rank, abs(r.score) AS w,
  row_number() OVER o - 1 AS k, sum(abs(r.score)) OVER o AS reached,
  sum(abs(r.score)) OVER (PARTITION BY d.set_name, d.perm) AS total,
  (SELECT count(*) FROM ranked) AS n_features
FROM drawn d JOIN ranked r USING (rank)
WINDOW o AS (PARTITION BY d.set_name, d.perm ORDER BY d.rank)""",
    "null_es": """
SELECT set_name, perm, v AS es FROM (
  SELECT set_name, perm, rank - 1 AS spot,
    (reached - w) / total - (rank - k) / (n_features - size)::DOUBLE AS v FROM null_hits
  UNION ALL
  SELECT set_name, perm, rank,
    reached / total - (rank - k) / (n_features - size)::DOUBLE FROM null_hits
)
QUALIFY row_number() OVER (
  PARTITION BY set_name, perm ORDER BY floor(abs(v) * 1e9 + 0.5) DESC, spot) = 1""",
    "means": """
SELECT set_name, avg(es) FILTER (es >= 0) AS mp, avg(es) FILTER (es <= 0) AS mn
FROM null_es GROUP BY set_name""",
    "nes": """
SELECT e.*, CASE WHEN e.es >= 0 THEN e.es / nullif(mp, 0) ELSE e.es / nullif(abs(mn), 0) END AS nes
FROM es e LEFT JOIN means USING (set_name)""",
    "null_nes": """
SELECT e.*, CASE WHEN e.es >= 0 THEN e.es / nullif(mp, 0) ELSE e.es / nullif(abs(mn), 0) END AS nes
FROM null_es e JOIN means USING (set_name)""",
    "pvals": """
SELECT e.set_name,
  avg(CASE WHEN e.es >= 0 THEN (n.es > e.es)::INT ELSE (n.es < e.es)::INT END)
    FILTER (CASE WHEN e.es >= 0 THEN n.es >= 0 ELSE n.es <= 0 END) AS np,
  avg(CASE WHEN e.es >= 0 THEN (n.es > e.es)::INT ELSE (n.es < e.es)::INT END) AS np_all
FROM es e JOIN null_es n USING (set_name) GROUP BY e.set_name""",
    # every real set against every null score, by brute force
    "fdr_num": """
SELECT set_name, avg(share) AS fdr_num FROM (
  SELECT r.set_name, n.perm,
    avg(CASE WHEN r.es > 0 THEN (floor(n.nes * 1e9 + 0.5) >= floor(r.nes * 1e9 + 0.5))::INT
             ELSE (floor(n.nes * 1e9 + 0.5) <= floor(r.nes * 1e9 + 0.5))::INT END) AS share
  FROM nes r JOIN null_nes n
    ON CASE WHEN r.es > 0 THEN n.nes >= 0 ELSE n.nes <= 0 END
  WHERE r.es <> 0 AND r.nes IS NOT NULL
  GROUP BY r.set_name, n.perm
) GROUP BY set_name""",
    "fdrs": """
SELECT set_name, fdr_num, den AS fdr_den,
  CASE WHEN sign(es) <> sign(nes) THEN 1.0 ELSE least(fdr_num / den, 1.0) END AS fdr
FROM (
  SELECT r.set_name, r.es, r.nes, f.fdr_num,
    CASE WHEN r.es > 0 THEN
      row_number() OVER (ORDER BY floor(r.nes * 1e9 + 0.5) DESC NULLS LAST, r.set_name)
        / (SELECT count(*) FROM nes WHERE nes >= 0)::DOUBLE
    ELSE
      row_number() OVER (ORDER BY floor(r.nes * 1e9 + 0.5) ASC NULLS LAST, r.set_name)
        / nullif((SELECT count(*) FROM nes WHERE nes <= 0), 0)::DOUBLE
    END AS den
  FROM nes r LEFT JOIN fdr_num f USING (set_name)
)""",
    "fwers": """
SELECT r.set_name,
  avg(CASE WHEN r.nes >= 0 THEN (floor(b.hi * 1e9 + 0.5) > floor(r.nes * 1e9 + 0.5))::INT
           ELSE (floor(b.lo * 1e9 + 0.5) < floor(r.nes * 1e9 + 0.5))::INT END) AS fwer
FROM nes r, (SELECT perm, max(nes) AS hi, min(nes) AS lo FROM null_nes GROUP BY perm) b
GROUP BY r.set_name""",
    "results": """
SELECT n.set_name, n.size, n.es, n.rank_at_max, n.score_at_max, n.n_features, n.nes, p.np,
  f.fdr, w.fwer
FROM nes n LEFT JOIN pvals p USING (set_name) LEFT JOIN fdrs f USING (set_name)
LEFT JOIN fwers w USING (set_name)""",
    "edge": """
SELECT h.set_name, h.feature, h.rank, h.score
FROM hits h JOIN es e USING (set_name)
WHERE CASE WHEN e.es >= 0 THEN h.rank <= e.rank_at_max ELSE h.rank >= e.rank_at_max END""",
    "edge_stats": """
SELECT set_name, n_edge, peak_rank, n_edge / size::DOUBLE AS tag_fraction,
  peak_rank / n_features::DOUBLE AS list_fraction,
  (n_edge / size::DOUBLE) / (1 - peak_rank / n_features::DOUBLE)
    / (n_features / (n_features - size)::DOUBLE) AS signal_strength
FROM (
  SELECT e.set_name, e.size, e.n_features, count(d.rank) AS n_edge,
    CASE WHEN e.es >= 0 THEN e.rank_at_max ELSE e.n_features - e.rank_at_max END AS peak_rank
  FROM es e LEFT JOIN edge d USING (set_name)
  GROUP BY e.set_name, e.size, e.n_features, e.es, e.rank_at_max
)""",
    "class_cells": """
SELECT f.feature, f.row_idx, f.value, l.class_idx
FROM features f JOIN side_labels l USING (sample) WHERE f.value IS NOT NULL""",
    "profile_cells": """
SELECT f.feature, f.row_idx, f.sample, f.value, l.num_value
FROM features f JOIN side_labels l USING (sample) WHERE f.value IS NOT NULL""",
    "dense_profile_cells": """
SELECT f.feature, f.row_idx, f.sample, f.value, l.num_value
FROM dense_features f JOIN vector_labels l USING (sample)""",
    "shuffled": f"""
SELECT p.perm, l.sample,
  CASE WHEN row_number() OVER (
    PARTITION BY p.perm ORDER BY md5('{SEED}:' || p.perm || ':' || l.sample), l.sample)
    <= (SELECT count(*) FROM vector_labels WHERE class_idx = 0) THEN 0 ELSE 1 END AS class_idx
FROM vector_labels l, (SELECT unnest(range({PERMS})) AS perm) p""",
}
PARTS["class_stats"] = """
SELECT feature, row_idx,
  count(*) FILTER (class_idx = 0) AS n0, count(*) FILTER (class_idx = 1) AS n1,
  avg(value) FILTER (class_idx = 0) AS mean0, avg(value) FILTER (class_idx = 1) AS mean1,
  median(value) FILTER (class_idx = 0) AS median0,
  median(value) FILTER (class_idx = 1) AS median1,
  coalesce(stddev_samp(value) FILTER (class_idx = 0), 0) AS raw0,
  coalesce(stddev_samp(value) FILTER (class_idx = 1), 0) AS raw1
FROM class_cells GROUP BY feature, row_idx"""


def floor_sql(sd: str, mean: str) -> str:
    return (
        f"greatest({sd}, CASE WHEN abs({mean}) <= 1e-9 THEN 0.2 ELSE 0.2 * abs({mean}) END)"
    )


PARTS["class_sds"] = f"""
SELECT *, {floor_sql("raw0", "mean0")} AS sd0, {floor_sql("raw1", "mean1")} AS sd1
FROM class_stats"""
# signal to noise of the dense matrix under permuted labels
PARTS["perm_scores"] = f"""
SELECT perm, feature, row_idx, (mean0 - mean1)
  / ({floor_sql("raw0", "mean0")} + {floor_sql("raw1", "mean1")}) AS score
FROM (
  SELECT s.perm, f.feature, f.row_idx,
    avg(f.value) FILTER (s.class_idx = 0) AS mean0,
    avg(f.value) FILTER (s.class_idx = 1) AS mean1,
    stddev_samp(f.value) FILTER (s.class_idx = 0) AS raw0,
    stddev_samp(f.value) FILTER (s.class_idx = 1) AS raw1
  FROM dense_features f JOIN shuffled s USING (sample)
  GROUP BY s.perm, f.feature, f.row_idx
)"""
PARTS["real_scores"] = f"""
SELECT feature, row_idx, (mean0 - mean1)
  / ({floor_sql("raw0", "mean0")} + {floor_sql("raw1", "mean1")}) AS score
FROM (
  SELECT f.feature, f.row_idx,
    avg(f.value) FILTER (s.class_idx = 0) AS mean0,
    avg(f.value) FILTER (s.class_idx = 1) AS mean1,
    stddev_samp(f.value) FILTER (s.class_idx = 0) AS raw0,
    stddev_samp(f.value) FILTER (s.class_idx = 1) AS raw1
  FROM dense_features f JOIN vector_labels s USING (sample)
  GROUP BY f.feature, f.row_idx
)"""
PARTS["perm_lists"] = """
SELECT perm, feature, score,
  row_number() OVER (PARTITION BY perm ORDER BY score DESC, row_idx) - 1 AS rank
FROM perm_scores"""
PARTS["label_hits"] = """
SELECT perm, set_name, rank, abs(score) AS w,
  row_number() OVER o - 1 AS k, sum(abs(score)) OVER o AS reached,
  sum(abs(score)) OVER g AS total, count(*) OVER g AS size, n
FROM (
  SELECT l.perm, s.set_name, l.rank, l.score, count(DISTINCT f.feature) AS n
  FROM perm_lists l JOIN dimension_sets s ON s.member = l.feature
  CROSS JOIN (SELECT DISTINCT feature FROM dense_features) f
  GROUP BY l.perm, s.set_name, l.rank, l.score
)
WINDOW g AS (PARTITION BY perm, set_name), o AS (PARTITION BY perm, set_name ORDER BY rank)"""
PARTS["pair_counts"] = """
SELECT a.set_name AS a, b.set_name AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b,
  count(*) AS inter, any_value(x.n) + any_value(y.n) - count(*) AS union_size,
  count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS jaccard
FROM part_sets a JOIN part_sets b ON a.member = b.member
JOIN (SELECT set_name, count(*) AS n FROM part_sets GROUP BY set_name) x ON x.set_name = a.set_name
JOIN (SELECT set_name, count(*) AS n FROM part_sets GROUP BY set_name) y ON y.set_name = b.set_name
GROUP BY a.set_name, b.set_name"""


# ---- parts of whole runs, put in place of the ones above --------------------

_S2N = "(mean0 - mean1) / (sd0 + sd1)"
MATRIX_RUN = {
    "ranked": f"""
SELECT feature, score, row_number() OVER (ORDER BY score DESC, row_idx) - 1 AS rank
FROM (SELECT feature, row_idx, {_S2N} AS score FROM class_sds WHERE n0 > 0 AND n1 > 0)""",
    "run_shuffled": f"""
SELECT p.perm, l.sample,
  CASE WHEN row_number() OVER (
    PARTITION BY p.perm ORDER BY md5('{SEED}:' || p.perm || ':' || l.sample), l.sample)
    <= (SELECT count(*) FROM side_labels WHERE class_idx = 0) THEN 0 ELSE 1 END AS class_idx
FROM side_labels l, (SELECT unnest(range({PERMS})) AS perm) p""",
    "run_stats": """
SELECT s.perm, f.feature, f.row_idx,
  avg(f.value) FILTER (s.class_idx = 0) AS mean0, avg(f.value) FILTER (s.class_idx = 1) AS mean1,
  coalesce(stddev_samp(f.value) FILTER (s.class_idx = 0), 0) AS raw0,
  coalesce(stddev_samp(f.value) FILTER (s.class_idx = 1), 0) AS raw1
FROM features f JOIN run_shuffled s USING (sample)
WHERE f.feature IN (SELECT feature FROM ranked)
GROUP BY s.perm, f.feature, f.row_idx""",
    "run_lists": f"""
SELECT perm, feature, score,
  row_number() OVER (PARTITION BY perm ORDER BY score DESC, row_idx) - 1 AS rank
FROM (SELECT perm, feature, row_idx, CASE WHEN mean0 IS NULL OR mean1 IS NULL THEN 0
  ELSE (mean0 - mean1) / ({floor_sql("raw0", "mean0")} + {floor_sql("raw1", "mean1")}) END AS score
  FROM run_stats)""",
    "null_hits": """
SELECT s.set_name, l.perm, z.size, l.rank, abs(l.score) AS w,
  row_number() OVER o - 1 AS k, sum(abs(l.score)) OVER o AS reached,
  sum(abs(l.score)) OVER (PARTITION BY s.set_name, l.perm) AS total,
  (SELECT count(*) FROM ranked) AS n_features
FROM run_lists l JOIN kept s ON s.member = l.feature JOIN kept_sizes z ON z.set_name = s.set_name
WINDOW o AS (PARTITION BY s.set_name, l.perm ORDER BY l.rank)""",
}
COLLAPSED_RUN = {
    "run_cells": """
SELECT m.symbol AS feature, f.sample, max(f.value) AS value
FROM features f JOIN id_map m ON m.probe = f.feature WHERE m.symbol <> ''
GROUP BY m.symbol, f.sample""",
    "class_cells": """
SELECT f.feature, f.feature AS row_idx, f.value, l.class_idx
FROM run_cells f JOIN side_labels l USING (sample)""",
    "ranked": MATRIX_RUN["ranked"],
    "kept": """
SELECT s.set_name, s.member
FROM symbol_sets s JOIN ranked r ON s.member = r.feature
WHERE s.set_name IN (SELECT set_name FROM symbol_sets GROUP BY set_name HAVING count(*) >= 15)
QUALIFY count(*) OVER (PARTITION BY s.set_name) BETWEEN 15 AND 100000""",
}


def sql(select: str, **replaced: str) -> str:
    """``select`` preceded by the parts it reads, and those they read."""
    parts = {**PARTS, **replaced}
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text):
            if word in parts and word not in needed:
                visit(parts[word])
                if word not in needed:
                    needed.append(word)

    visit(select)
    if not needed:
        return select
    # a part read more than once is computed once
    body = ",\n".join(f"{n} AS MATERIALIZED ({parts[n].strip()})" for n in needed)
    return f"WITH {body}\n{select.strip()}"

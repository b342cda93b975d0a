"""Weighted running-sum statistic over a ranked list.

Only the hits of a set are touched. With hits at ranks r_k (k = 0..n-1), the
inclusive sum of hit weights W_k and the miss step m = 1/(N-n), the running sum
is ``W_k - (r_k - k)*m`` at hit k and ``W_{k-1} - (r_k - k)*m`` just before it;
the extreme deviation is always one of these points (or the end of the list
where the hit weights do not add up to one).

A set or list may hold a large part of all hits. Running sums are therefore cut
into rank blocks: block totals are prefix-summed per set (few rows), and rows
accumulate only inside their block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import (
    POWER_GUARD,
    WEIGHTED_GUARD,
    finite_guard,
    is_finite,
    tie_key,
)
from ..functions.scalars import attach
from .rank import list_sizes

# Ranks per block of a running sum.
BLOCK = 1 << 16
# Bits of a rank beside a deviation of at most 1 in one long.
RANK_BITS = 33

Scheme = tuple[Column, Column, Column]


def _classic() -> Scheme:
    one = F.lit(1.0)
    return one, one, F.lit(0)


def _weighted() -> Scheme:
    w = finite_guard(F.abs("score"), WEIGHTED_GUARD)
    return w, w, F.lit(0)


def _weighted_p2() -> Scheme:
    w = finite_guard(F.col("score") * F.col("score"), POWER_GUARD)
    return w, w, F.lit(0)


def _weighted_p1_5() -> Scheme:
    """The total uses abs(s)^1.5, a hit uses s^1.5: a negative score is not a
    number and counts as a fixed 1e-6."""
    total = finite_guard(F.pow(F.abs("score"), F.lit(1.5)), POWER_GUARD)
    usable = is_finite("score") & (F.col("score") >= 0)
    hit = F.when(usable, F.pow(F.col("score"), F.lit(1.5))).otherwise(F.lit(0.0))
    return total, hit, F.when(usable, 0).otherwise(1)


def _weighted_p1_5_symmetric() -> Scheme:
    w = finite_guard(F.pow(F.abs("score"), F.lit(1.5)), POWER_GUARD)
    return w, w, F.lit(0)


# Scheme -> (share of the set's total, hit weight before division by the total,
# 1 where the hit counts as the fixed small weight instead).
SCHEMES: dict[str, Callable[[], Scheme]] = {
    "classic": _classic,
    "weighted": _weighted,
    "weighted_p2": _weighted_p2,
    "weighted_p1.5": _weighted_p1_5,
    "weighted_p1.5_symmetric": _weighted_p1_5_symmetric,
}
SUMS_TO_ONE = {"classic", "weighted", "weighted_p2", "weighted_p1.5_symmetric"}


def set_hits(ranked: DataFrame, sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., set_name, feature, score, rank) of list features in a set. Sets may
    carry the ``by`` columns themselves, else they apply to every list."""
    own = [c for c in by if c in sets.columns]
    return ranked.select(*by, "feature", "score", "rank").join(
        sets.select(*own, "set_name", F.col("member").alias("feature")), [*own, "feature"]
    )


def score_hits(
    hits: DataFrame,
    sizes: DataFrame,
    scheme: str = "weighted",
    by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Running sums at every hit.

    ``hits`` is (by.., set_name, rank, score, ..), ``sizes`` is (by..,
    n_features). Adds hit_no, n_hits, n_features, weight, running_es and
    before_es."""
    by = list(by)
    key = [*by, "set_name"]
    total, hit, fixed = SCHEMES[scheme]()
    rows = (
        hits.withColumn("_total", total)
        .withColumn("_hit", hit)
        .withColumn("_fixed", fixed)
        .withColumn("_block", F.floor(F.col("rank") / block))
    )
    blocks = rows.groupBy(*key, "_block").agg(
        F.sum("_total").alias("_bt"),
        F.sum("_hit").alias("_bh"),
        F.sum("_fixed").alias("_bf"),
        F.count(F.lit(1)).alias("_bn"),
    )
    whole = Window.partitionBy(*key)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0)
    blocks = blocks.select(
        *key,
        "_block",
        F.sum("_bt").over(whole).alias("_sum"),
        F.sum("_bn").over(whole).alias("n_hits"),
        F.coalesce(F.sum("_bh").over(before), zero).alias("_h0"),
        F.coalesce(F.sum("_bf").over(before), zero).alias("_f0"),
        F.coalesce(F.sum("_bn").over(before), zero).alias("_n0"),
    )
    blocks = attach(blocks, sizes, by)
    inside = Window.partitionBy(*key, "_block").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, 0
    )
    weight = F.try_divide(F.col("_hit"), F.col("_sum")) + F.col("_fixed") * POWER_GUARD
    prior = F.try_divide(F.col("_h0"), F.col("_sum")) + F.col("_f0") * POWER_GUARD
    return (
        rows.join(blocks, [*key, "_block"])
        .withColumn("weight", weight)
        .withColumn("hit_no", F.col("_n0") + F.row_number().over(inside) - 1)
        .withColumn("_reached", prior + F.sum("weight").over(inside))
        .withColumn(
            "_missed",
            F.coalesce(
                F.try_divide(
                    F.col("rank") - F.col("hit_no"), F.col("n_features") - F.col("n_hits")
                ),
                F.lit(0.0),
            ),
        )
        .withColumn("running_es", F.col("_reached") - F.col("_missed"))
        .withColumn("before_es", F.col("_reached") - F.col("weight") - F.col("_missed"))
        .select(
            *hits.columns, "hit_no", "n_hits", "n_features", "weight", "running_es", "before_es"
        )
    )


def hits(
    ranked: DataFrame, sets: DataFrame, scheme: str = "weighted", by: Sequence[str] = ()
) -> DataFrame:
    """Scored hits of every set in every list."""
    return score_hits(set_hits(ranked, sets, by), list_sizes(ranked, by), scheme, by)


def pick_extreme(
    scored: DataFrame, scheme: str = "weighted", by: Sequence[str] = ()
) -> DataFrame:
    """(by.., set_name, size, es, rank_at_max): the first largest deviation."""
    key = [*by, "set_name"]
    ahead = (F.col("rank") > F.col("hit_no")) & (tie_key("before_es") >= tie_key("running_es"))
    points = scored.select(
        *key,
        "rank",
        "n_hits",
        "n_features",
        "weight",
        F.when(ahead, F.col("before_es")).otherwise(F.col("running_es")).alias("_es"),
        F.when(ahead, F.col("rank") - 1).otherwise(F.col("rank")).alias("_at"),
    )
    # deviation above, then the smaller rank, in one decimal of 38 digits: hash
    # aggregation keeps plain numbers, it would have to sort for a struct
    order = tie_key("_es").cast("decimal(19,0)") * F.lit(1 << RANK_BITS).cast("decimal(11,0)") + (
        F.lit((1 << RANK_BITS) - 1) - F.col("_at")
    ).cast("decimal(11,0)")
    aggs = [
        F.max("n_hits").alias("size"),
        F.max_by("_es", order).alias("es"),
        F.max_by("_at", order).alias("rank_at_max"),
    ]
    if scheme in SUMS_TO_ONE:
        return points.groupBy(*key).agg(*aggs)
    aggs += [
        F.sum("weight").alias("_all"),
        F.max("rank").alias("_last"),
        F.max("n_features").alias("n_features"),
    ]
    further = (F.col("_last") < F.col("n_features") - 1) & (
        tie_key(F.col("_all") - 1) > tie_key("es")
    )
    return points.groupBy(*key).agg(*aggs).select(
        *key,
        "size",
        F.when(further, F.col("_all") - 1).otherwise(F.col("es")).alias("es"),
        F.when(further, F.col("n_features") - 1).otherwise(F.col("rank_at_max")).alias("rank_at_max"),
    )


def score_at(es: DataFrame, ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``score_at_max``: the list's score at ``rank_at_max``."""
    at = ranked.select(
        *by, F.col("rank").alias("rank_at_max"), F.col("score").alias("score_at_max")
    )
    return es.join(at, [*by, "rank_at_max"], "left").select(*es.columns, "score_at_max")


def enrichment(
    ranked: DataFrame, sets: DataFrame, scheme: str = "weighted", by: Sequence[str] = ()
) -> DataFrame:
    """(by.., set_name, size, es, rank_at_max, score_at_max)."""
    es = pick_extreme(hits(ranked, sets, scheme, by), scheme, by)
    return score_at(es, ranked, by)


def running_es_profile(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.select(*by, "set_name", "hit_no", "rank", "running_es")


def running_es_full(
    ranked: DataFrame, scored: DataFrame, set_names: DataFrame
) -> DataFrame:
    """Running sum at each of the N ranks, for the sets asked for.

    Between two hits the sum falls by one step per rank: a line from each hit to
    the next, found by joining hit numbers, not by gathering a set. Lines are cut at
    the blocks of ``BLOCK`` ranks and the pieces dealt by (set, block), so a line
    of any length is many tasks; the work is the N rows per set that are the result."""
    chosen = scored.join(set_names.select("set_name").distinct(), "set_name", "left_semi")
    nxt = chosen.select(
        "set_name", (F.col("hit_no") - 1).alias("hit_no"), F.col("rank").alias("_next")
    )
    step = F.coalesce(
        F.try_divide(F.lit(1.0), F.col("n_features") - F.col("n_hits")), F.lit(0.0)
    )
    spans = chosen.join(nxt, ["set_name", "hit_no"], "left").select(
        "set_name",
        F.col("rank").alias("_from"),
        F.coalesce(F.col("_next"), F.col("n_features")).alias("_to"),
        F.col("running_es").alias("_start"),
        step.alias("_step"),
    )
    # ranks before the first hit
    head = chosen.filter((F.col("hit_no") == 0) & (F.col("rank") > 0)).select(
        "set_name",
        F.lit(0).cast("long").alias("_from"),
        F.col("rank").alias("_to"),
        (-step).alias("_start"),
        step.alias("_step"),
    )
    first, last = F.expr(f"_from div {BLOCK}"), F.expr(f"(_to - 1) div {BLOCK}")
    pieces = (
        spans.unionByName(head)
        .select("*", F.explode(F.sequence(first, last)).alias("_block"))
        .repartition("set_name", "_block")
    )
    begin = F.greatest(F.col("_from"), F.col("_block") * BLOCK)
    end = F.least(F.col("_to"), (F.col("_block") + 1) * BLOCK)
    rank = F.explode(F.sequence(begin, end - 1)).alias("rank")
    return pieces.select("set_name", "_from", "_start", "_step", rank).select(
        "set_name",
        "rank",
        (F.col("_start") - (F.col("rank") - F.col("_from")) * F.col("_step")).alias("running_es"),
    )

"""Normalised scores and significance.

Tables: ``es`` (set_name, es, ..), ``null_es`` (set_name, perm, es) with
permutations numbered from 0. Zero counts as positive and as negative; nominal
and family-wise p are strict, the FDR numerator includes equality. Where the
null has no value of the needed sign the result is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import TIE_SCALE
from ..functions.scalars import attach, with_one_row
from .rank import number_rows

# Cut-offs of the significance counts.
NOMINAL_CUTS = (0.01, 0.05)
FDR_CUT = 0.25


def _same_sign_means(null_es: DataFrame, key: list[str]) -> DataFrame:
    e = F.col("es")
    return null_es.groupBy(*key).agg(
        F.avg(F.when(e >= 0, e)).alias("_pos"), F.avg(F.when(e <= 0, e)).alias("_neg")
    )


def _by_mean(c: str) -> Column:
    e = F.col(c)
    return F.when(e >= 0, F.try_divide(e, F.col("_pos"))).otherwise(
        F.try_divide(e, F.abs("_neg"))
    )


def normalize(
    es: DataFrame, null_es: DataFrame, mode: str = "meandiv", by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(es with ``nes``, null with ``nes``). ``meandiv`` divides by the mean of
    the same-sign null of the same set, ``none`` keeps the score."""
    if mode == "none":
        return es.withColumn("nes", F.col("es")), null_es.withColumn("nes", F.col("es"))
    if mode != "meandiv":
        raise ValueError(f"unknown normalisation {mode!r}; meandiv or none")
    key = [*by, "set_name"]
    means = _same_sign_means(null_es, key)
    real = es.join(means, key, "left").select(*es.columns, _by_mean("es").alias("nes"))
    null = null_es.join(means, key).select(*null_es.columns, _by_mean("es").alias("nes"))
    return real, null


def nominal_p(es: DataFrame, null_es: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of the null strictly beyond ES: ``np`` among the same-sign null,
    ``np_all`` among all of it."""
    key = [*by, "set_name"]
    real = es.select(*key, F.col("es").alias("_real"))
    e, real_es = F.col("es"), F.col("_real")
    pos = real_es >= 0
    same = F.when(pos, e >= 0).otherwise(e <= 0)
    beyond = F.when(pos, e > real_es).otherwise(e < real_es)
    return (
        null_es.join(real, key)
        .groupBy(*key)
        .agg(
            F.avg(F.when(same, beyond.cast("double"))).alias("np"),
            F.avg(beyond.cast("double")).alias("np_all"),
        )
    )


def _level(c: Column | str) -> Column:
    """NES as a long, so that double noise does not break ties."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * TIE_SCALE + 0.5)


def rank_of_nes(nes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank of every set among all real NES from each end, ties by name."""
    ties = F.col("set_name").asc()
    down = number_rows(nes, [_level("nes").desc_nulls_last(), ties], by, "_rank_down")
    return number_rows(down, [_level("nes").asc_nulls_last(), ties], by, "_rank_up")


def fdr(es_nes: DataFrame, null_nes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., set_name, fdr) with its parts.

    Numerator: mean over permutations having a same-sign null of the share of
    that null at least as extreme. Denominator: share of same-sign real sets at
    least as extreme, by rank over all sets. Real and null scores of a
    permutation and sign meet in one window of at most 2*S rows, so no pair of
    (set, set) is formed. A set with ES 0 or without NES has no q."""
    by = list(by)
    key = [*by, "set_name"]
    real = es_nes.select(*key, "es", "nes")
    placed = rank_of_nes(real, by)
    signs = real.groupBy(*by).agg(
        F.count(F.when(F.col("nes") >= 0, 1)).alias("_n_pos"),
        F.count(F.when(F.col("nes") <= 0, 1)).alias("_n_neg"),
    )
    perms = null_nes.groupBy(*by).agg(F.max("perm").alias("_last"))
    usable = real.filter("es <> 0 AND nes IS NOT NULL")
    side = F.when(F.col("es") > 0, 1).otherwise(-1)
    real_rows = attach(usable, perms, by).filter("_last IS NOT NULL").select(
        *by,
        F.explode(F.sequence(F.lit(0).cast("int"), F.col("_last"))).alias("perm"),
        side.alias("side"),
        _level("nes").alias("level"),
        F.lit(0).alias("is_null"),
        "set_name",
    )
    null = null_nes.filter("nes IS NOT NULL")
    sides = F.explode(
        F.when(F.col("nes") > 0, F.array(F.lit(1)))
        .when(F.col("nes") < 0, F.array(F.lit(-1)))
        .otherwise(F.array(F.lit(1), F.lit(-1)))
    )
    null_rows = null.select(
        *by,
        "perm",
        sides.alias("side"),
        _level("nes").alias("level"),
        F.lit(1).alias("is_null"),
        F.lit(None).cast("string").alias("set_name"),
    )
    extreme_first = (F.col("side") * F.col("level")).desc()
    upto = Window.partitionBy(*by, "perm", "side").orderBy(extreme_first).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*by, "perm", "side")
    shares = (
        real_rows.unionByName(null_rows)
        .withColumn("_beyond", F.sum("is_null").over(upto))
        .withColumn("_size", F.sum("is_null").over(whole))
        .filter((F.col("is_null") == 0) & (F.col("_size") > 0))
        .groupBy(*key)
        .agg(F.avg(F.col("_beyond") / F.col("_size")).alias("fdr_num"))
    )
    pos = F.col("es") > 0
    place = F.when(pos, F.col("_rank_down")).otherwise(F.col("_rank_up")) + 1
    count = F.when(pos, F.col("_n_pos")).otherwise(F.col("_n_neg"))
    q = F.try_divide(F.col("fdr_num"), F.col("fdr_den"))
    return (
        attach(placed.join(shares, key, "left"), signs, by)
        .withColumn("fdr_den", F.try_divide(place, count))
        .select(
            *key,
            "fdr_num",
            F.when(F.col("fdr_num").isNotNull(), F.col("fdr_den")).alias("fdr_den"),
            F.when(
                q.isNotNull(),
                F.when(F.signum("es") != F.signum("nes"), 1.0).otherwise(F.least(q, F.lit(1.0))),
            ).alias("fdr"),
        )
    )


def fwer(es_nes: DataFrame, null_nes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of permutations whose best null NES over all sets is strictly
    beyond NES. The best of each permutation and the sets of a sign meet in one
    window of sets + permutations rows; equal levels do not count."""
    by = list(by)
    key = [*by, "set_name"]
    best = null_nes.groupBy(*by, "perm").agg(F.max("nes").alias("hi"), F.min("nes").alias("lo"))
    ends = F.explode(
        F.array(
            F.struct(F.lit(1).alias("side"), F.col("hi").alias("nes")),
            F.struct(F.lit(-1).alias("side"), F.col("lo").alias("nes")),
        )
    ).alias("end")
    null_rows = best.filter("hi IS NOT NULL").select(*by, ends).select(
        *by, F.lit(None).cast("string").alias("set_name"), "end.side", "end.nes", F.lit(1).alias("is_null")
    )
    side = F.when(F.col("nes") >= 0, 1).when(F.col("nes") < 0, -1)
    real_rows = es_nes.select(*key, side.alias("side"), "nes", F.lit(0).alias("is_null"))
    rows = real_rows.unionByName(null_rows).withColumn("_place", -F.col("side") * _level("nes"))
    whole = Window.partitionBy(*by, "side")
    beyond = whole.orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
    share = F.try_divide(
        F.coalesce(F.sum("is_null").over(beyond), F.lit(0)).cast("double"), F.sum("is_null").over(whole)
    )
    return (
        rows.withColumn("_share", share)
        .filter("is_null = 0")
        .select(*key, F.when(F.col("nes").isNotNull(), F.col("_share")).alias("fwer"))
    )


def significance(
    es: DataFrame, null_es: DataFrame, mode: str = "meandiv", by: Sequence[str] = ()
) -> DataFrame:
    """ES table plus nes, np, fdr and fwer."""
    key = [*by, "set_name"]
    real, null = normalize(es, null_es, mode, by)
    return (
        real.join(nominal_p(es, null_es, by).select(*key, "np"), key, "left")
        .join(fdr(real, null, by).select(*key, "fdr"), key, "left")
        .join(fwer(real, null, by), key, "left")
    )


def count_significant(results: DataFrame) -> DataFrame:
    """Per sign: sets, nominal p at two cut-offs, FDR at one."""
    side = F.when(F.col("es") > 0, "pos").when(F.col("es") < 0, "neg")
    return (
        results.withColumn("side", side)
        .filter("side IS NOT NULL")
        .groupBy("side")
        .agg(
            F.count(F.lit(1)).alias("n_sets"),
            F.count(F.when(F.col("np") <= NOMINAL_CUTS[0], 1)).alias("np_01"),
            F.count(F.when(F.col("np") <= NOMINAL_CUTS[1], 1)).alias("np_05"),
            F.count(F.when(F.col("fdr") <= FDR_CUT, 1)).alias("fdr_25"),
        )
    )


def validate_results(results: DataFrame, null_es: DataFrame) -> DataFrame:
    """Checks (check, n_bad, ok): any result, set names unique, every set with
    the same number of permutations."""
    some = results.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit("non_empty").alias("check"), F.when(F.col("_n") == 0, 1).otherwise(0).alias("n_bad")
    )
    repeated = (
        results.groupBy("set_name").agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.count(F.when(F.col("_n") > 1, 1)).alias("n_bad"))
        .select(F.lit("unique_names").alias("check"), "n_bad")
    )
    counts = results.select("set_name").distinct().join(
        null_es.groupBy("set_name").agg(F.count(F.lit(1)).alias("_p")), "set_name", "left"
    ).withColumn("_p", F.coalesce("_p", F.lit(0)))
    uneven = with_one_row(counts, counts.agg(F.max("_p").alias("_most"))).agg(
        F.count(F.when(F.col("_p") < F.col("_most"), 1)).alias("n_bad")
    ).select(F.lit("same_permutations").alias("check"), "n_bad")
    return (
        some.unionByName(repeated)
        .unionByName(uneven)
        .withColumn("n_bad", F.col("n_bad").cast("long"))
        .withColumn("ok", F.col("n_bad") == 0)
    )

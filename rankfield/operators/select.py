"""Order statistics per group by counting digits, without sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread as deal, tasks_for

DIGIT_BITS = 16  # at most 2^16 counts of a group meet in one task
SALTS = 64  # tasks that the values of one group are dealt over, where the number of tasks is given
BROADCAST_GROUPS = 100_000  # group names sent to every task, at most; more are joined by shuffle
_MANTISSA = 52
_LOWEST, _HIGHEST = -1022, 1023  # exponents of normal doubles


def ordered_image(value: Column) -> Column:
    """The double as a whole number of 64 bits in the same order: exponent and
    mantissa of its magnitude, with its sign. Both zeros are 0, NaN is above
    infinity, NULL stays NULL."""
    v = value.cast("double")
    size = F.abs(v)
    # the rounded logarithm can be one off on either side
    near = F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LOWEST)), F.lit(_HIGHEST))
    low = F.when(size < F.pow(F.lit(2.0), near), near - 1)
    high = F.when(size / 2 >= F.pow(F.lit(2.0), near), near + 1)
    exponent = F.greatest(F.coalesce(low, high, near), F.lit(_LOWEST))
    digits = (size / F.pow(F.lit(2.0), exponent) * F.lit(2.0**_MANTISSA)).cast("long")
    step = 1 << _MANTISSA
    finite = (exponent - _LOWEST).cast("long") * step + digits
    top = (_HIGHEST - _LOWEST + 2) * step
    image = (
        F.when(F.isnan(v), F.lit(top + 1))
        .when(size == float("inf"), F.lit(top))
        .when(size == 0, F.lit(0))
        .otherwise(finite)
    )
    return F.when(v < 0, -image).otherwise(image)


def select_places(counted: DataFrame, places: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The values at 0-based places of each group's ascending order.

    ``counted`` holds (by.., value, _c), every value of a group once with its
    number of rows, no NULL; ``places`` (by.., _place) the places asked for.
    Returns (by.., _place, value); places outside a group have no row.

    Four passes count the next 16 bits of the values' ordered images, each among
    those that share the bits chosen before. A group is counts only, map-side
    combined, so one that holds most rows is as light as any other; places whose
    bits hold one value alone are settled and take no part in later passes."""
    by = list(by)
    images = counted.select(*by, F.col(value).alias("_v"), "_c", ordered_image(F.col(value)).alias("_image"))
    state = places.select(
        *by, "_place", F.col("_place").alias("_rest"), F.lit(None).cast("long").alias("_bits")
    )
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        last = shift + DIGIT_BITS
        first_pass = last == 64
        bits = F.lit(0).cast("long") if first_pass else F.shiftright("_image", last)
        among = images.select(*by, bits.alias("_in"), F.shiftright("_image", shift).alias("_next"), "_v", "_c")
        if not first_pass:
            asked = state.filter("_least < _most").select(*by, F.col("_bits").alias("_in")).distinct()
            among = among.join(asked, [*by, "_in"], "left_semi")
        counts = among.groupBy(*by, "_in", "_next").agg(
            F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        ahead = Window.partitionBy(*by, "_in").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_n").over(ahead)).withColumn("_ahead", F.col("_upto") - F.col("_n"))
        keys = [counts[c].alias(f"_k{i}") for i, c in enumerate(by)]
        counts = counts.select(*keys, "_in", "_next", "_lo", "_hi", "_ahead", "_upto")
        match = (F.col("_ahead") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto"))
        for i, c in enumerate(by):
            match &= F.col(c) == F.col(f"_k{i}")
        if first_pass:
            state = state.join(counts, match).select(
                *by,
                "_place",
                (F.col("_rest") - F.col("_ahead")).alias("_rest"),
                F.col("_next").alias("_bits"),
                F.col("_lo").alias("_least"),
                F.col("_hi").alias("_most"),
            )
            continue
        match &= (F.col("_bits") == F.col("_in")) & (F.col("_least") < F.col("_most"))
        state = state.join(counts, match, "left").select(
            *by,
            "_place",
            (F.col("_rest") - F.coalesce("_ahead", F.lit(0))).alias("_rest"),
            F.coalesce("_next", "_bits").alias("_bits"),
            F.coalesce("_lo", "_least").alias("_least"),
            F.coalesce("_hi", "_most").alias("_most"),
        )
    return state.select(*by, "_place", F.col("_least").alias(value))


def group_median(
    df: DataFrame, by: Sequence[str], value: str, name: str, spread: int = 1 << DIGIT_BITS, tasks: int | None = None
) -> DataFrame:
    """Exact median per group, missing values skipped, NULL where there is none.

    Equal values are counted first. Groups of up to ``spread`` different values,
    no more than a digit pass counts in one task, are read off in one window over
    those counts; groups of more are told apart by digits. Values are compared
    as doubles. Shuffles have ``tasks`` tasks, or as many as the files behind ``df`` need."""
    by = list(by)
    tasks = tasks or tasks_for(df)
    there = F.when(F.col(value).isNotNull(), F.col("_c")).otherwise(0)
    salt = ["_salt"] if tasks else []
    salted = df.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALTS))) if tasks else df
    counted = cut(deal(salted, tasks, *by, *salt).groupBy(*by, *salt, value).agg(F.count(F.lit(1)).alias("_c")))
    counts = counted.groupBy(*by, *salt).agg(F.count(value).alias("_d"), F.sum(there).alias("_n"))
    if tasks:  # counted where the values are, then dealt by group
        counts = deal(counts, tasks, *by).groupBy(*by).agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    wide = cut(
        counts.filter(F.col("_d") > spread)
        .select(*by, "_n")
    )
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    n_wide = wide.count()
    names = F.broadcast(wide.select(*by)) if n_wide <= BROADCAST_GROUPS else wide.select(*by)

    group = Window.partitionBy(*by)
    ahead = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    narrow = counted.join(names, by, "left_anti") if n_wide else counted
    narrow = deal(narrow, tasks, *by)
    narrow = narrow.withColumn("_n", F.sum(there).over(group)).withColumn("_upto", F.sum(there).over(ahead))

    def at(place):
        inside = (F.col("_upto") - there <= place) & (place < F.col("_upto"))
        return F.max(F.when(inside, F.col(value)))

    settled = narrow.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(name))
    if not n_wide:
        return settled
    places = wide.select(*by, F.explode(F.array_distinct(F.array(low, high))).alias("_place"))
    among = counted.join(names, by, "left_semi").filter(F.col(value).isNotNull())
    found = select_places(among, places, by, value)
    return settled.unionByName(found.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(name)))

"""Numeric Column helpers shared by the operators.

Missing values are NULL everywhere: Spark aggregates skip NULL, not NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements for non-finite scores, per scheme.
WEIGHTED_GUARD = 0.01
POWER_GUARD = 1e-6
# Floor of a standard deviation relative to its mean, and the
# distance from zero below which a mean counts as zero.
SD_FLOOR = 0.2
NEAR_ZERO = 1e-9
# Two deviations closer than this are one tie (double noise must not pick it).
TIE_SCALE = 1e9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_guard(c: Column | str, replacement: float) -> Column:
    c = col(c)
    return F.when(is_finite(c), c).otherwise(F.lit(replacement))


def missing_if_nan(c: Column | str) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def is_positive(c: Column | str) -> Column:
    return col(c) >= 0


def is_negative(c: Column | str) -> Column:
    return col(c) <= 0


def variance(c: Column | str, biased: bool = False) -> Column:
    """Aggregate: divides by n or n-1; one value has variance 0, none is NULL."""
    c = col(c)
    if biased:
        return F.var_pop(c)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.var_samp(c))


def stddev_floor(sd: Column | str, mean: Column | str, fix_low: bool = True) -> Column:
    sd, mean = col(sd), col(mean)
    if not fix_low:
        return sd
    least = F.when(F.abs(mean) <= NEAR_ZERO, F.lit(SD_FLOOR)).otherwise(
        F.lit(SD_FLOOR) * F.abs(mean)
    )
    return F.when(sd.isNotNull(), F.greatest(sd, least))


def tie_key(c: Column | str) -> Column:
    """Absolute deviation as a long, so that ties compare equal."""
    return F.floor(F.abs(col(c)) * TIE_SCALE + 0.5)

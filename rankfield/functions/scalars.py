"""Attach the columns of a one-row aggregate to every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    packed = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("_one"))
    return df.withColumn("_one", packed.scalar()).select(
        *df.columns, *[F.col("_one")[c].alias(c) for c in one.columns]
    )


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals per ``by`` group, or one row of totals, next to every row."""
    return df.join(totals, list(by)) if by else with_one_row(df, totals)

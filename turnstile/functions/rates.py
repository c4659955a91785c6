"""Percentages and display rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage, null where the whole is 0."""
    return F.try_divide(part * F.lit(100.0), whole)


def percent_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(percent(part, whole), F.lit(0.0))


def percent_of_at_least_one(part: Column, whole: Column) -> Column:
    return part * F.lit(100.0) / F.greatest(whole, F.lit(1))


def for_display(df: DataFrame) -> DataFrame:
    """Cents columns as amounts with 2 places, percentages with 1, both rounded half-even."""
    shown = []
    for name in df.columns:
        if name.endswith("_cents"):
            amount = F.bround(F.col(name).cast("decimal(20,0)") / 100, 2)
            shown.append(amount.cast("decimal(18,2)").alias(name.removesuffix("_cents")))
        elif name.endswith("_pct"):
            shown.append(F.bround(F.col(name), 1).alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)

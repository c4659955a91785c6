"""Zero-filled result grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C

def with_zero_keys(counts: DataFrame, keys: DataFrame, key: str, measure: str) -> DataFrame:
    """Add a 0 for every key of the fixed range ``keys`` and sum again: no join needed."""
    zeros = keys.select(F.col(key), F.lit(0).cast("long").alias(measure))
    return counts.select(key, measure).unionByName(zeros).groupBy(key).agg(
        F.sum(measure).alias(measure)
    )


def with_age_range(cells: DataFrame, group: str, measure: str) -> DataFrame:
    """Every age of the chart range for every group that occurs in ``cells``."""
    ages = F.explode(F.sequence(F.lit(C.AGE_FIRST), F.lit(C.AGE_LAST))).alias("age")
    zeros = cells.select(group).distinct().select(group, ages, F.lit(0).cast("long").alias(measure))
    both = cells.select(group, "age", measure).unionByName(zeros)
    return both.groupBy(group, "age").agg(F.sum(measure).alias(measure))


def dense(
    cells: DataFrame, row: str, column: str, measure: str, labels: Sequence[str]
) -> DataFrame:
    """The cells of the given column labels, with a 0 where a row has none.

    Cells of other labels are left out. Every row label that occurs gets one zero per label
    of the list and the sums are taken again, so nothing is joined.
    """
    named = cells.filter(F.col(row).isNotNull() & F.col(column).isin(list(labels)))
    rows = cells.filter(F.col(row).isNotNull()).select(row).distinct()
    wanted = F.explode(F.array(*[F.lit(label) for label in dict.fromkeys(labels)]))
    zeros = rows.select(row, wanted.alias(column), F.lit(0).cast("long").alias(measure))
    both = named.select(row, column, measure).unionByName(zeros)
    return both.groupBy(row, column).agg(F.sum(measure).alias(measure))

"""Several groupings of the same tickets from one scan.

A grouping says which rows count and by what they are grouped. Alone it is a filter and an aggregate. Together, every
row is marked once for each grouping that it counts in, and one aggregate over (grouping, keys) serves all: its map-side
sums shrink the marked rows before the only shuffle. The cells, a few for each show, day or label, are written to the
shared folder, and each metric goes on from its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.session import shared_dir, written

_GROUPING = "grouping"


class Grouping(NamedTuple):
    """Rows that count (a null counts as no), and the keys that they are grouped by."""

    where: Column
    keys: Mapping[str, Column]


def alone(rows: DataFrame, grouping: Grouping, measures: Mapping[str, Column]) -> DataFrame:
    """The keys and the measures (aggregates over the rows) of one grouping."""
    keyed = [column.alias(name) for name, column in grouping.keys.items()]
    totals = [column.alias(name) for name, column in measures.items()]
    return rows.filter(grouping.where).groupBy(*keyed).agg(*totals)


def together(
    rows: DataFrame, groupings: Mapping[str, Grouping], measures: Mapping[str, Column]
) -> dict[str, DataFrame]:
    """What `alone` gives for each grouping, by name, from one scan of the rows.

    Without a shared folder nothing can be written, and each frame scans for itself.
    """
    if shared_dir(rows.sparkSession) is None:
        return {name: alone(rows, g, measures) for name, g in groupings.items()}
    names = list(dict.fromkeys(key for g in groupings.values() for key in g.keys))

    def mark(name: str, g: Grouping) -> Column:
        keys = [g.keys.get(key, F.lit(None)).alias(f"key_{key}") for key in names]
        return F.when(g.where, F.struct(F.lit(name).alias(_GROUPING), *keys))

    marks = F.array_compact(F.array(*[mark(name, g) for name, g in groupings.items()]))
    marked = rows.select("*", F.inline(marks))
    cells = marked.groupBy(_GROUPING, *[f"key_{key}" for key in names]).agg(
        *[column.alias(name) for name, column in measures.items()]
    )
    cells = written(cells, "cells")
    return {
        name: cells.filter(F.col(_GROUPING) == name).select(
            *[F.col(f"key_{key}").alias(key) for key in g.keys], *measures
        )
        for name, g in groupings.items()
    }

"""A rollup by show and day, kept beside the tickets and merged for any selection of shows and days.

Counts and sums add up exactly. Different buyers do not add up: each cell holds a theta sketch of its buyers, and sketches of
cells merge into the sketch of their union, whose size is an estimate. Sketches also intersect: a show's returning
buyers are those that it shares with earlier cells. Up to `NOMINAL` buyers a sketch is exact; beyond, the relative standard error
is about one over the square root of that number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, in_kept, in_selection, is_online, selected
from turnstile.frame import Tickets
from turnstile.functions.money import revenue_cents

#: Logarithm of the number of hashes that a sketch keeps, and that number; a full sketch takes 8 bytes each.
LG_NOMINAL = 12
NOMINAL = 1 << LG_NOMINAL

_EXACT = ("tickets", "revenue_cents", "total", "canceled")


def build(tickets: Tickets) -> DataFrame:
    """One row per show and order day of the online tickets: sums over kept rows, counts over all, and the kept rows' buyers.

    Tickets without a date are a day of their own (null), which only an open selection counts.
    """
    tickets.require("event_name", "order_date", "deal_price_cents", "contact_id")
    counts = in_kept(Filters.of(), tickets) & is_online()
    mine = F.coalesce(counts, F.lit(False))
    status = F.col("ticket_status")
    rows = selected(tickets, Filters.of()).withColumn("mine", mine)
    kept_price = F.when(F.col("mine"), F.col("deal_price_cents"))
    return (
        rows.withColumn("deal_price_cents", kept_price)
        .groupBy("event_name", "order_date")
        .agg(
            F.count_if("mine").alias("tickets"),
            revenue_cents(tickets).alias("revenue_cents"),
            F.count("ticket_id").alias("total"),
            F.count_if(status == C.CANCELED).alias("canceled"),
            F.theta_sketch_agg(
                F.when(F.col("mine"), F.col("contact_id").cast("string")), LG_NOMINAL
            ).alias("buyers"),
        )
    )


def write(rollup: DataFrame, path: str) -> None:
    """Replace the months that ``rollup`` holds and leave the others, so that a month can be rolled up again."""
    month = F.coalesce(F.date_format("order_date", "yyyy-MM"), F.lit("none"))
    (
        rollup.withColumn("month", month)
        .hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def _days(rollup: DataFrame, f: Filters) -> DataFrame:
    cells = rollup.filter(in_selection(f))
    if f.date_range:
        low, high = f.date_range
        cells = cells.filter(F.col("order_date").between(F.lit(low), F.lit(high)))
    return cells


def _merged(cells: DataFrame, *keys: str) -> DataFrame:
    """Sums and united buyers of the cells, over ``keys`` or all."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _EXACT]
    return cells.groupBy(*keys).agg(*sums, F.theta_union_agg("buyers", LG_NOMINAL).alias("buyers"))


def _size(sketch: str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def headline(rollup: DataFrame, f: Filters) -> DataFrame:
    """One row: tickets, revenue_cents, total, canceled (exact) and buyers (estimated) of the selection's days.

    Unlike the dated headline over tickets, total and canceled are those of the days, too.
    """
    return _merged(_days(rollup, f)).select(*_EXACT, _size("buyers").alias("buyers"))


def by_show(rollup: DataFrame, f: Filters) -> DataFrame:
    """The same per show."""
    cells = _merged(_days(rollup, f), "event_name")
    return cells.select("event_name", *_EXACT, _size("buyers").alias("buyers"))


def returning(rollup: DataFrame, f: Filters, since: date) -> DataFrame:
    """Per show: estimated buyers from ``since`` on, and how many of them bought for any selected show before that day."""
    cells = rollup.filter(in_selection(f) & F.col("order_date").isNotNull())
    now = F.col("order_date") >= F.lit(since)
    before = cells.filter(~now).agg(F.theta_union_agg("buyers", LG_NOMINAL).alias("earlier"))
    shows = _merged(cells.filter(now), "event_name")
    # One sketch of bounded size (32 KB), handed to every show.
    both = shows.withColumn("earlier", before.scalar())
    known = F.theta_sketch_estimate(F.theta_intersection("buyers", "earlier"))
    return both.select(
        "event_name",
        _size("buyers").alias("buyers"),
        F.when(F.col("earlier").isNotNull(), F.coalesce(known, F.lit(0))).otherwise(0).cast("long").alias("returning"),
    )

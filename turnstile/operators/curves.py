"""Per-show daily curves, shared by the sales and the comparison metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.frame import Tickets
from turnstile.functions.money import revenue_cents

UNTIL, SINCE_FIRST = "until", "since_first"


def daily(tickets: Tickets) -> DataFrame:
    """One row per (show, order date) with counts, revenue, running totals and both x axes.

    Tickets shrink to one row per show and day before the only other shuffle, so
    the windows hold days of one show, never tickets. Orders without a date lend
    their start time to the show and then leave.
    """
    per_day = (
        tickets.rows.filter(F.col("event_name").isNotNull())
        .groupBy("event_name", "order_date")
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            revenue_cents(tickets).alias("revenue_cents"),
            F.min("event_start_time").alias("start"),
        )
    )
    return of_days(per_day)


def of_days(per_day: DataFrame) -> DataFrame:
    """The curves from one row per show and order date: tickets, revenue and earliest start."""
    show = Window.partitionBy("event_name")
    to_date = show.orderBy("order_date").rowsBetween(Window.unboundedPreceding, 0)
    dated = F.col("order_date").isNotNull()
    return (
        per_day.select(
            "event_name",
            "order_date",
            "tickets",
            "revenue_cents",
            F.min("start").over(show).alias("show_start"),
            F.min("order_date").over(show).alias("first_sale"),
            F.sum(F.when(dated, F.col("tickets"))).over(to_date).alias("cum_tickets"),
            F.sum(F.when(dated, F.col("revenue_cents"))).over(to_date).alias("cum_revenue_cents"),
        )
        .filter(dated)
        .select(
            "event_name",
            "order_date",
            "tickets",
            "revenue_cents",
            "cum_tickets",
            "cum_revenue_cents",
            F.datediff(F.to_date("show_start"), F.col("order_date")).alias("days_until"),
            F.datediff(F.col("order_date"), F.col("first_sale")).alias("days_since_first"),
        )
    )


def axis_column(axis: str) -> str:
    return {UNTIL: "days_until", SINCE_FIRST: "days_since_first"}[axis]


def choose_axis(kept_rows: DataFrame, tickets: Tickets) -> str:
    """Days until the show wherever any start time is known; one small job decides."""
    if not tickets.has("event_start_time"):
        return SINCE_FIRST
    known = kept_rows.filter(F.col("event_start_time").isNotNull()).select("event_start_time")
    return SINCE_FIRST if known.isEmpty() else UNTIL

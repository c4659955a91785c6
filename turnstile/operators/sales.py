"""Sales over time, by weekday, by lead time, and the per-show summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, in_kept, kept, selected
from turnstile.frame import Tickets
from turnstile.functions.money import revenue_cents
from turnstile.functions.normalise import weekday_label, weekday_no
from turnstile.functions.rates import percent_of_at_least_one
from turnstile.operators import curves, grids
from turnstile.operators.onepass import Grouping, together


def daily(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets per order date and show."""
    tickets.require("order_date", "event_name")
    rows = kept(tickets, f)
    return (
        rows.filter(F.col("order_date").isNotNull() & F.col("event_name").isNotNull())
        .groupBy("order_date", "event_name")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def _curve(tickets: Tickets, f: Filters) -> DataFrame:
    tickets.require("order_date", "event_name")
    return curves.daily(Tickets(kept(tickets, f), tickets.present))


def daily_by_axis(tickets: Tickets, f: Filters, axis: str = curves.UNTIL) -> DataFrame:
    """Daily tickets with x as days until the show or since its first sale."""
    x = F.col(curves.axis_column(axis))
    return (
        _curve(tickets, f)
        .select("event_name", "order_date", x.alias("x"), "tickets")
        .filter(F.col("x").isNotNull())
    )


def cumulative(tickets: Tickets, f: Filters, axis: str | None = None) -> DataFrame:
    """Running total of tickets per show in date order; with ``axis`` also the day on it as x."""
    curve = _curve(tickets, f)
    if axis is None:
        return curve.select("event_name", "order_date", "cum_tickets")
    x = F.col(curves.axis_column(axis))
    return curve.select("event_name", "order_date", x.alias("x"), "cum_tickets").filter(
        F.col("x").isNotNull()
    )


def by_weekday(tickets: Tickets, f: Filters) -> DataFrame:
    """Seven rows, Monday first, zeros included."""
    tickets.require("order_dow")
    rows = kept(tickets, f)
    counts = (
        rows.filter(F.col("order_date").isNotNull())
        .groupBy(weekday_no(F.col("order_date")).cast("long").alias("weekday_no"))
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    week = rows.sparkSession.range(len(C.WEEKDAY_LABELS)).select(F.col("id").alias("weekday_no"))
    filled = grids.with_zero_keys(counts, week, "weekday_no", "tickets")
    number = F.col("weekday_no").cast("int")
    return filled.select(
        number.alias("weekday_no"), weekday_label(number).alias("weekday"), "tickets"
    )


def _lead_bucket() -> Column:
    days = F.col("days_before_event")
    return F.least(days, F.lit(float(C.LEAD_TIME_LAST_BUCKET))).cast("int")


def lead_time(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets by whole days before the show; the last bucket is open-ended."""
    tickets.require("days_before_event")
    return (
        kept(tickets, f)
        .filter(F.col("days_before_event") >= 0)
        .groupBy(_lead_bucket().alias("bucket"))
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def heatmap(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets by weekday and hour, occurring cells only."""
    tickets.require("order_dow", "order_hour")
    return (
        kept(tickets, f)
        .filter(F.col("order_date").isNotNull())
        .groupBy(weekday_no(F.col("order_date")).alias("weekday_no"), F.col("order_hour").alias("hour"))
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def heatmap_dense(tickets: Tickets, f: Filters) -> DataFrame:
    """One row per weekday present, one column per hour."""
    hours = list(range(24))
    wide = heatmap(tickets, f).groupBy("weekday_no").pivot("hour", hours).agg(F.sum("tickets"))
    return wide.select(
        "weekday_no", *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(f"h{h}") for h in hours]
    )


def heatmap_scale(tickets: Tickets, f: Filters) -> DataFrame:
    """Largest heat-map cell, at least 1."""
    return _scale(heatmap(tickets, f))


def _scale(cells: DataFrame) -> DataFrame:
    largest = F.coalesce(F.max("tickets"), F.lit(0))
    return cells.agg(F.greatest(largest, F.lit(1)).alias("max_tickets"))


def _summary_counts() -> dict[str, Column]:
    status = F.col("ticket_status")
    return {
        "total": F.count("ticket_id"),
        "valid": F.count_if(status == C.VALID),
        "canceled": F.count_if(status == C.CANCELED),
        "scanned": F.count("ticket_scanned_at"),
        "first_sale": F.min("order_date"),
    }


def show_summary(tickets: Tickets, f: Filters) -> DataFrame:
    """Per-show table over the whole selection; its revenue includes canceled tickets."""
    measures = {
        "start": F.min("event_start_time"),
        "revenue_cents": revenue_cents(tickets),
        **_summary_counts(),
    }
    return _summary(selected(tickets, f).groupBy("event_name").agg(
        *[column.alias(name) for name, column in measures.items()]
    ))


def _summary(per_show: DataFrame) -> DataFrame:
    return per_show.select(
        "event_name",
        "total",
        "valid",
        "canceled",
        "scanned",
        "revenue_cents",
        F.datediff(F.to_date("start"), F.col("first_sale")).alias("days_on_sale"),
        percent_of_at_least_one(F.col("scanned"), F.col("valid")).alias("attendance_pct"),
        percent_of_at_least_one(F.col("canceled"), F.col("total")).alias("cancel_pct"),
    )


def _weekdays(per_day: DataFrame) -> DataFrame:
    """Seven rows from tickets per day."""
    spark = per_day.sparkSession
    week = spark.range(len(C.WEEKDAY_LABELS)).select(F.col("id").alias("weekday_no"))
    counts = (
        per_day.filter(F.col("order_date").isNotNull())
        .groupBy(weekday_no(F.col("order_date")).cast("long").alias("weekday_no"))
        .agg(F.sum("tickets").alias("tickets"))
    )
    filled = grids.with_zero_keys(counts, week, "weekday_no", "tickets")
    number = F.col("weekday_no").cast("int")
    return filled.select(
        number.alias("weekday_no"), weekday_label(number).alias("weekday"), "tickets"
    )


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every sales chart that the input's columns allow, from one scan."""
    counts, dated = in_kept(f, tickets), F.col("order_date").isNotNull()
    event = {"event_name": F.col("event_name")}
    groupings = {"summary": Grouping(F.lit(True), event)}
    if tickets.has("order_date"):
        groupings["days"] = Grouping(counts, event | {"order_date": F.col("order_date")})
        hours = {"weekday_no": weekday_no(F.col("order_date")), "hour": F.col("order_hour")}
        groupings["heatmap"] = Grouping(counts & dated, hours)
    if tickets.has("days_before_event"):
        days = F.col("days_before_event")
        groupings["lead"] = Grouping(counts & (days >= 0), {"bucket": _lead_bucket()})
    measures = {
        "tickets": F.count(F.lit(1)),
        "start": F.min("event_start_time"),
        "revenue_cents": revenue_cents(tickets),
        **_summary_counts(),
    }
    found = together(selected(tickets, f), groupings, measures)

    out: dict[str, DataFrame] = {}
    if tickets.has("order_date"):
        days = found["days"].select("event_name", "order_date", "tickets", "revenue_cents", "start")
        curve = curves.of_days(days)
        multi = len(f.events) > 1 if f.events else found["summary"].limit(2).count() > 1
        if multi:
            # Both curves share one axis, which is told with them.
            known = not days.filter(F.col("start").isNotNull()).isEmpty()
            axis = curves.UNTIL if known and tickets.has("event_start_time") else curves.SINCE_FIRST
            x = F.col(curves.axis_column(axis))
            placed = curve.withColumn("x", x).filter(x.isNotNull()).withColumn("axis", F.lit(axis))
            out["cumulative"] = placed.select("event_name", "order_date", "x", "cum_tickets", "axis")
            out["daily"] = placed.select("event_name", "order_date", "x", "tickets", "axis")
        else:
            out["cumulative"] = curve.select("event_name", "order_date", "cum_tickets")
            out["daily"] = days.filter(dated).select("order_date", "event_name", "tickets")
        out["by_weekday"] = _weekdays(days)
        cells = found["heatmap"].select("weekday_no", "hour", "tickets")
        out["heatmap"] = cells
        out["heatmap_scale"] = _scale(cells)
    if tickets.has("days_before_event"):
        out["lead_time"] = found["lead"].select("bucket", "tickets")
    out["show_summary"] = _summary(found["summary"])
    return out

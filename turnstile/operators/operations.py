"""Attendance, cancellation, status and category mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, in_kept, is_online, kept_online, selected
from turnstile.frame import Tickets
from turnstile.functions import money
from turnstile.functions.rates import percent
from turnstile.operators import grids
from turnstile.operators.onepass import Grouping, together


def attendance_by_show(tickets: Tickets, f: Filters) -> DataFrame:
    """Present and absent tickets per show and paid/free, with the show's total to order by.

    One aggregate per show holds both kinds, so the total needs no second shuffle.
    """
    measures = [column.alias(name) for name, column in _attendance(tickets).items()]
    return _present_and_absent(kept_online(tickets, f).groupBy("event_name").agg(*measures))


def _attendance(tickets: Tickets) -> dict[str, Column]:
    """Rows, ids and scans of either kind."""
    has_price = tickets.has("deal_price_cents")
    kind = money.paid_or_free(tickets) if has_price else F.lit(C.PAID)
    out = {}
    for label, prefix in ((C.PAID, "paid"), (C.FREE, "free")):
        mine = kind == label
        out[f"{prefix}_rows"] = F.count_if(mine)
        out[f"{prefix}_total"] = F.count(F.when(mine, F.col("ticket_id")))
        out[f"{prefix}_present"] = F.count(F.when(mine, F.col("ticket_scanned_at")))
    return out


def _present_and_absent(per_show: DataFrame) -> DataFrame:
    def part(label: str, prefix: str):
        return F.struct(
            F.lit(label).alias("ticket_type"),
            F.col(f"{prefix}_rows").alias("n"),
            F.col(f"{prefix}_total").alias("total"),
            F.col(f"{prefix}_present").alias("present"),
        )

    return (
        per_show.select(
            "event_name",
            (F.col("paid_total") + F.col("free_total")).alias("show_total"),
            F.inline(F.array(part(C.PAID, "paid"), part(C.FREE, "free"))),
        )
        .filter(F.col("n") > 0)
        .select(
            "event_name",
            "ticket_type",
            "total",
            "present",
            (F.col("total") - F.col("present")).alias("absent"),
            "show_total",
        )
    )


def cancellation_by_show(tickets: Tickets, f: Filters) -> DataFrame:
    """Canceled share of the tickets with an id, over the whole selection."""
    return (
        selected(tickets, f)
        .groupBy("event_name")
        .agg(
            F.count("ticket_id").alias("total"),
            F.count_if(F.col("ticket_status") == C.CANCELED).alias("canceled"),
        )
        .select("*", percent(F.col("canceled"), F.col("total")).alias("cancel_pct"))
    )


def status_distribution(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets per known status, over the whole selection."""
    return (
        selected(tickets, f)
        .filter(F.col("ticket_status").isNotNull())
        .groupBy("ticket_status")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def category_mix(
    tickets: Tickets, f: Filters, categories: Sequence[str] | None = None
) -> DataFrame:
    """Tickets per show and category; zeros for the ``categories`` named."""
    tickets.require("deal_title")
    label = money.category(tickets) if tickets.has("deal_price_cents") else F.col("deal_title")
    cells = (
        kept_online(tickets, f)
        .withColumn("category", label)
        .filter(F.col("event_name").isNotNull() & F.col("category").isNotNull())
        .groupBy("event_name", "category")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    if categories is None:
        return cells
    return grids.dense(cells, "event_name", "category", "tickets", categories)


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every operations chart that the input's columns allow, from one scan."""
    event, status = F.col("event_name"), F.col("ticket_status")
    counts = in_kept(f, tickets) & is_online()
    groupings = {
        "attendance_by_show": Grouping(counts, {"event_name": event}),
        "cancellation_by_show": Grouping(F.lit(True), {"event_name": event}),
        "status_distribution": Grouping(status.isNotNull(), {"ticket_status": status}),
    }
    if tickets.has("deal_title"):
        label = money.category(tickets) if tickets.has("deal_price_cents") else F.col("deal_title")
        groupings["category_mix"] = Grouping(
            counts & event.isNotNull() & label.isNotNull(), {"event_name": event, "category": label}
        )
    measures = {
        "tickets": F.count(F.lit(1)),
        "total": F.count("ticket_id"),
        "canceled": F.count_if(status == C.CANCELED),
        **_attendance(tickets),
    }
    found = together(selected(tickets, f), groupings, measures)
    out = {
        "attendance_by_show": _present_and_absent(found["attendance_by_show"]),
        "cancellation_by_show": found["cancellation_by_show"].select(
            "event_name",
            "total",
            "canceled",
            percent(F.col("canceled"), F.col("total")).alias("cancel_pct"),
        ),
        "status_distribution": found["status_distribution"].select("ticket_status", "tickets"),
    }
    if "category_mix" in found:
        out["category_mix"] = found["category_mix"].select("event_name", "category", "tickets")
    return out

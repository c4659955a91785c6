"""Revenue by show, ticket category, payment method and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.filters import Filters, in_kept, kept, selected
from turnstile.frame import Tickets
from turnstile.functions import money, normalise
from turnstile.operators.onepass import Grouping, together


def by_show(tickets: Tickets, f: Filters) -> DataFrame:
    """Revenue per show, largest first."""
    tickets.require("deal_price_cents")
    return (
        kept(tickets, f)
        .groupBy("event_name")
        .agg(money.revenue_cents(tickets).alias("revenue_cents"))
        .orderBy(F.desc("revenue_cents"), "event_name")
    )


def _by(rows: DataFrame, tickets: Tickets, key: str) -> DataFrame:
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("ticket_id").alias("tickets"),
            money.revenue_cents(tickets).alias("revenue_cents"),
        )
    )


def by_category(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets and revenue per category; everything without a positive price is one category."""
    tickets.require("deal_price_cents", "deal_title")
    rows = kept(tickets, f).withColumn("category", money.category(tickets))
    return _by(rows, tickets, "category").orderBy(F.desc("revenue_cents"), "category")


def by_payment(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets and revenue per payment method over paid tickets."""
    tickets.require("deal_price_cents", "payment_method")
    rows = (
        kept(tickets, f)
        .filter(money.price(tickets) > 0)
        .withColumn("payment_method", normalise.payment_method(F.col("payment_method")))
    )
    return _by(rows, tickets, "payment_method").orderBy(F.desc("revenue_cents"), "payment_method")


def free_ticket_types(tickets: Tickets, f: Filters) -> DataFrame:
    """Count of zero-price tickets per title."""
    tickets.require("deal_price_cents", "deal_title")
    return (
        kept(tickets, f)
        .filter((money.price(tickets) == 0) & F.col("deal_title").isNotNull())
        .groupBy("deal_title")
        .agg(F.count(F.lit(1)).alias("tickets"))
        .orderBy(F.desc("tickets"), "deal_title")
    )


def paid_vs_free(tickets: Tickets, f: Filters) -> DataFrame:
    """Count of paid and free tickets by the by-zero rule."""
    tickets.require("deal_price_cents")
    return (
        kept(tickets, f)
        .groupBy(money.paid_or_free(tickets).alias("ticket_type"))
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def daily(tickets: Tickets, f: Filters) -> DataFrame:
    """Revenue per order date."""
    tickets.require("deal_price_cents", "order_date")
    return (
        kept(tickets, f)
        .filter(F.col("order_date").isNotNull())
        .groupBy("order_date")
        .agg(money.revenue_cents(tickets).alias("revenue_cents"))
    )


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every revenue chart that the input's columns and the selection allow, from one scan."""
    if not tickets.has("deal_price_cents"):
        return {}
    counts, price = in_kept(f, tickets), money.price(tickets)
    groupings = {"by_show": Grouping(counts, {"event_name": F.col("event_name")})}
    if tickets.has("deal_title"):
        title = F.col("deal_title")
        groupings["by_category"] = Grouping(counts, {"category": money.category(tickets)})
        groupings["free_ticket_types"] = Grouping(
            counts & (price == 0) & title.isNotNull(), {"deal_title": title}
        )
    if tickets.has("payment_method"):
        method = normalise.payment_method(F.col("payment_method"))
        groupings["by_payment"] = Grouping(counts & (price > 0), {"payment_method": method})
    groupings["paid_vs_free"] = Grouping(counts, {"ticket_type": money.paid_or_free(tickets)})
    if tickets.has("order_date"):
        dated = F.col("order_date").isNotNull()
        groupings["daily"] = Grouping(counts & dated, {"order_date": F.col("order_date")})
    measures = {
        "n": F.count(F.lit(1)),
        "with_id": F.count("ticket_id"),
        "revenue_cents": money.revenue_cents(tickets),
    }
    found = together(selected(tickets, f), groupings, measures)
    out: dict[str, DataFrame] = {}
    multi = len(f.events) > 1 if f.events else f.is_multi(tickets)
    if multi:
        shows = found["by_show"].select("event_name", "revenue_cents")
        out["by_show"] = shows.orderBy(F.desc("revenue_cents"), "event_name")
    for name, key in (("by_category", "category"), ("by_payment", "payment_method")):
        if name in found:
            cells = found[name].filter(F.col(key).isNotNull())
            cells = cells.select(key, F.col("with_id").alias("tickets"), "revenue_cents")
            out[name] = cells.orderBy(F.desc("revenue_cents"), key)
    tickets_of = F.col("n").alias("tickets")
    if "free_ticket_types" in found:
        free = found["free_ticket_types"].select("deal_title", tickets_of)
        out["free_ticket_types"] = free.orderBy(F.desc("tickets"), "deal_title")
    out["paid_vs_free"] = found["paid_vs_free"].select("ticket_type", tickets_of)
    if not multi and "daily" in found:
        out["daily"] = found["daily"].select("order_date", "revenue_cents")
    return out

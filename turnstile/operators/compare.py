"""Shows side by side: one reference show against the others of the selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, in_kept, in_selection, kept, selected
from turnstile.frame import Tickets
from turnstile.functions.money import is_paid, paid_or_free, revenue_cents
from turnstile.functions.rates import percent
from turnstile.operators import curves
from turnstile.operators.onepass import Grouping, together

_METRICS = ["tickets", "revenue_cents", "paid_pct", "attendance_pct"]


def reference_show(tickets: Tickets, f: Filters) -> str | None:
    """The asked-for show if selected, else the first by name; open selections are looked up."""
    if f.events:
        return f.ref_event if f.ref_event in f.events else min(f.events)
    name = F.col("event_name")
    asked = F.max(name == f.ref_event) if f.ref_event else F.lit(False)
    first, known = tickets.rows.agg(F.min(name), asked).first()
    return f.ref_event if known else first


def _selected_shows(tickets: Tickets, f: Filters) -> DataFrame:
    """Names of the selection, also of shows without a single row."""
    if f.events:
        names = F.array(*[F.lit(e) for e in f.events])
        return tickets.rows.sparkSession.range(1).select(F.explode(names).alias("event_name"))
    return tickets.rows.filter(in_selection(f)).select("event_name").distinct()


def show_kpis(tickets: Tickets, f: Filters) -> DataFrame:
    """Rows, revenue and two shares per selected show; a show without sales has null shares."""
    flagged = Tickets(
        tickets.rows.filter(in_selection(f)).withColumn("in_kept", in_kept(f, tickets)),
        tickets.present,
    )
    measures = [column.alias(name) for name, column in _sold(flagged, F.col("in_kept")).items()]
    return _kpis(flagged.rows.groupBy("event_name").agg(*measures), tickets, f)


def _sold(tickets: Tickets, sold: Column) -> dict[str, Column]:
    return {
        "tickets": F.count_if(sold),
        "revenue_cents": revenue_cents(tickets, sold),
        "paid": F.count_if(sold & is_paid(tickets)),
        "scanned": F.count(F.when(sold, F.col("ticket_scanned_at"))),
    }


def _kpis(per_show: DataFrame, tickets: Tickets, f: Filters) -> DataFrame:
    if f.events:
        zero = [F.lit(0).cast("long").alias(c) for c in per_show.columns[1:]]
        asked = _selected_shows(tickets, f).select("event_name", *zero)
        sums = [F.sum(c).alias(c) for c in per_show.columns[1:]]
        per_show = per_show.unionByName(asked).groupBy("event_name").agg(*sums)
    return per_show.select(
        "event_name",
        "tickets",
        "revenue_cents",
        percent(F.col("paid"), F.col("tickets")).alias("paid_pct"),
        percent(F.col("scanned"), F.col("tickets")).alias("attendance_pct"),
    )


def _long(per_show: DataFrame) -> DataFrame:
    values = [F.col(m).cast("double").alias(m) for m in _METRICS]
    return per_show.select("event_name", *values).unpivot("event_name", _METRICS, "metric", "value")


def ref_vs_avg(tickets: Tickets, f: Filters, ref: str | None = None) -> DataFrame:
    """Reference value, mean of the other shows' values and their difference, per metric."""
    return _against(show_kpis(tickets, f), ref or reference_show(tickets, f))


def _against(kpis: DataFrame, ref: str | None) -> DataFrame:
    is_ref = F.col("event_name") == ref
    return (
        _long(kpis)
        .groupBy("metric")
        .agg(
            F.max(F.when(is_ref, F.col("value"))).alias("ref"),
            F.avg(F.when(~is_ref, F.col("value"))).alias("avg_others"),
        )
        .select("*", (F.col("ref") - F.col("avg_others")).alias("delta"))
    )


def leave_one_out(tickets: Tickets, f: Filters) -> DataFrame:
    """Every show in turn as the reference: its value and the mean of all the others."""
    values = _long(show_kpis(tickets, f))
    totals = values.groupBy("metric").agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )
    others = F.when(
        F.col("value").isNull(), F.try_divide(F.col("total"), F.col("n"))
    ).otherwise(F.try_divide(F.col("total") - F.col("value"), F.col("n") - 1))
    # One row per metric name, four in all: a bounded broadcast.
    return values.join(F.broadcast(totals), "metric").select(
        "event_name", "metric", "value", others.alias("avg_others")
    )


def revenue(tickets: Tickets, f: Filters) -> DataFrame:
    """Revenue per show, largest first."""
    return (
        kept(tickets, f)
        .groupBy("event_name")
        .agg(revenue_cents(tickets).alias("revenue_cents"))
        .orderBy(F.desc("revenue_cents"), "event_name")
    )


def tickets_sold(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets with an id per show, most first."""
    return (
        kept(tickets, f)
        .groupBy("event_name")
        .agg(F.count("ticket_id").alias("tickets"))
        .orderBy(F.desc("tickets"), "event_name")
    )


def loyalty(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers of a show seen in no other selected show, and those seen in another one.

    Tickets shrink to one row per buyer and show. A buyer whose first and last show by
    name are the same has one show; the others of a show's buyers return.
    """
    tickets.require("contact_id")
    pairs = (
        kept(tickets, f)
        .filter(F.col("contact_id").isNotNull())
        .groupBy("contact_id", "event_name")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    return _loyalty(pairs, tickets, f)


def _loyalty(pairs: DataFrame, tickets: Tickets, f: Filters) -> DataFrame:
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    single = (
        pairs.groupBy("contact_id")
        .agg(F.min("event_name").alias("event_name"), F.max("event_name").alias("last"))
        .filter(F.col("event_name") == F.col("last"))
        .select("event_name", one.alias("first_time"), zero.alias("buyers"))
    )
    seen = pairs.select("event_name", zero.alias("first_time"), one.alias("buyers"))
    none = _selected_shows(tickets, f).select(
        "event_name", zero.alias("first_time"), zero.alias("buyers")
    )
    return (
        seen.unionByName(single)
        .unionByName(none)
        .groupBy("event_name")
        .agg(
            F.sum("first_time").alias("first_time"),
            (F.sum("buyers") - F.sum("first_time")).alias("returning"),
        )
    )


def paid_free(tickets: Tickets, f: Filters) -> DataFrame:
    """Paid and free tickets per show, both columns always there."""
    tickets.require("deal_price_cents")
    kind = paid_or_free(tickets)
    return (
        kept(tickets, f)
        .groupBy("event_name")
        .agg(F.count_if(kind == C.PAID).alias("paid"), F.count_if(kind == C.FREE).alias("free"))
    )


def evolution(tickets: Tickets, f: Filters, ref: str | None = None, axis: str = curves.UNTIL) -> DataFrame:
    """Daily and cumulative tickets and revenue per show on a common day axis, by role."""
    tickets.require("order_date")
    ref = ref or reference_show(tickets, f)
    return _by_role(curves.daily(Tickets(kept(tickets, f), tickets.present)), ref, axis)


def _by_role(curve: DataFrame, ref: str | None, axis: str) -> DataFrame:
    role = F.when(F.col("event_name") == ref, "ref").otherwise("other")
    return curve.select(
        role.alias("role"),
        "event_name",
        F.col(curves.axis_column(axis)).alias("dia"),
        "tickets",
        "cum_tickets",
        "revenue_cents",
        "cum_revenue_cents",
    ).filter(F.col("dia").isNotNull())


def evolution_avg_others(
    tickets: Tickets, f: Filters, ref: str | None = None, axis: str = curves.UNTIL
) -> DataFrame:
    """Mean curve of the other shows, each day over the shows that have a row on it."""
    return _mean_of_others(evolution(tickets, f, ref, axis))


def _mean_of_others(curve: DataFrame) -> DataFrame:
    measures = ["tickets", "cum_tickets", "revenue_cents", "cum_revenue_cents"]
    return (
        curve.filter(F.col("role") == "other")
        .groupBy("dia")
        .agg(*[F.avg(m).alias(f"avg_{m}") for m in measures])
    )


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every comparison chart, from one scan; empty unless at least two shows are selected."""
    if not f.is_multi(tickets):
        return {}
    sold, event = F.coalesce(in_kept(f, tickets), F.lit(False)), F.col("event_name")
    groupings = {"shows": Grouping(F.lit(True), {"event_name": event})}
    if tickets.has("order_date"):
        keys = {"event_name": event, "order_date": F.col("order_date")}
        groupings["days"] = Grouping(sold, keys)
    if tickets.has("contact_id"):
        contact = F.col("contact_id")
        keys = {"contact_id": contact, "event_name": event}
        groupings["pairs"] = Grouping(sold & contact.isNotNull(), keys)
    kind = paid_or_free(tickets)
    measures = {
        **_sold(tickets, sold),
        "with_id": F.count(F.when(sold, F.col("ticket_id"))),
        "paid_kind": F.count_if(sold & (kind == C.PAID)),
        "free_kind": F.count_if(sold & (kind == C.FREE)),
        "start": F.min(F.when(sold, F.col("event_start_time"))),
    }
    found = together(selected(tickets, f), groupings, measures)

    shows = found["shows"]
    ref = reference_show(Tickets(shows, tickets.present), f)
    kpis = _kpis(shows.select("event_name", *_sold(tickets, sold)), tickets, f)
    sales = shows.filter(F.col("tickets") > 0)
    ids = F.col("with_id").alias("tickets")
    out = {
        "ref_vs_avg": _against(kpis, ref).withColumn("ref_event", F.lit(ref)),
        "revenue": sales.select("event_name", "revenue_cents").orderBy(
            F.desc("revenue_cents"), "event_name"
        ),
        "tickets": sales.select("event_name", ids).orderBy(F.desc("tickets"), "event_name"),
    }
    if "pairs" in found:
        out["loyalty"] = _loyalty(
            found["pairs"].select("contact_id", "event_name", "tickets"),
            Tickets(shows, tickets.present),
            f,
        )
    if tickets.has("deal_price_cents"):
        kinds = (F.col("paid_kind").alias("paid"), F.col("free_kind").alias("free"))
        out["paid_free"] = sales.select("event_name", *kinds)
    if "days" in found:
        days = found["days"].select("event_name", "order_date", "tickets", "revenue_cents", "start")
        known = tickets.has("event_start_time") and not days.filter(F.col("start").isNotNull()).isEmpty()
        axis = curves.UNTIL if known else curves.SINCE_FIRST
        curve, named = _by_role(curves.of_days(days), ref, axis), F.lit(axis).alias("axis")
        out["evolution"] = curve.select("*", named)
        out["evolution_avg_others"] = _mean_of_others(curve).select("*", named)
    return out

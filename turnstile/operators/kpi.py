"""Headline indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, in_kept, in_selection, is_online
from turnstile.frame import Tickets
from turnstile.functions.money import revenue_cents
from turnstile.functions.rates import percent_or_zero


def headline(tickets: Tickets, f: Filters, approximate: bool = False) -> DataFrame:
    """One row of six indicators and the counts behind the rates, from one scan.

    The three scopes differ in channel and dates only, so they travel as flags on
    the selected rows. Cancellation covers the whole selection; everything is 0
    when no sale is kept. ``approximate`` estimates the number of buyers, which saves
    the shuffle by buyer.
    """
    flagged = Tickets(
        tickets.rows.filter(in_selection(f))
        .withColumn("in_kept", in_kept(f, tickets))
        .withColumn("in_online", is_online())
        .withColumn("kept_online", F.col("in_kept") & F.col("in_online")),
        tickets.present,
    )
    is_kept, online, both = F.col("in_kept"), F.col("in_online"), F.col("kept_online")
    optin = F.col("contact_newsletter_optin")
    count_buyers = F.approx_count_distinct if approximate else F.count_distinct
    counts = flagged.rows.agg(
        F.count_if(is_kept).alias("tickets"),
        count_buyers(F.when(is_kept, F.col("contact_id"))).alias("buyers"),
        revenue_cents(flagged, is_kept).alias("revenue_cents"),
        F.count_if(both).alias("on_total"),
        F.count(F.when(both, F.col("ticket_scanned_at"))).alias("scanned"),
        F.count_if(online).alias("sel_on_total"),
        F.count_if(online & (F.col("ticket_status") == C.CANCELED)).alias("canceled"),
        F.count_if(both & optin).alias("optin_true"),
        F.count(F.when(both, optin)).alias("optin_known"),
    )
    cancel = percent_or_zero(F.col("canceled"), F.col("sel_on_total"))
    return counts.select(
        "tickets",
        "buyers",
        "revenue_cents",
        percent_or_zero(F.col("scanned"), F.col("on_total")).alias("attendance_pct"),
        F.when(F.col("tickets") == 0, 0.0).otherwise(cancel).alias("cancel_pct"),
        percent_or_zero(F.col("optin_true"), F.col("optin_known")).alias("optin_pct"),
        "scanned",
        "on_total",
        "canceled",
        "sel_on_total",
        "optin_true",
        "optin_known",
    )

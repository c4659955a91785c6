"""Where online tickets come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.filters import Filters, in_kept, is_online, kept_online, selected
from turnstile.frame import Tickets
from turnstile.operators import grids
from turnstile.operators.onepass import Grouping, together


def by_channel(tickets: Tickets, f: Filters) -> DataFrame:
    """Tickets per acquisition channel, fewest first."""
    tickets.require("utm_source")
    return (
        kept_online(tickets, f)
        .filter(F.col("utm_source").isNotNull())
        .groupBy("utm_source")
        .agg(F.count(F.lit(1)).alias("tickets"))
        .orderBy("tickets", "utm_source")
    )


def channel_by_medium(
    tickets: Tickets, f: Filters, media: Sequence[str] | None = None
) -> DataFrame:
    """Channel by medium, and each channel's total to order by; zeros for the ``media`` named."""
    tickets.require("utm_source", "utm_medium")
    cells = (
        kept_online(tickets, f)
        .filter(F.col("utm_source").isNotNull() & F.col("utm_medium").isNotNull())
        .groupBy("utm_source", "utm_medium")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    if media is not None:
        cells = grids.dense(cells, "utm_source", "utm_medium", "tickets", media)
    total = F.sum("tickets").over(Window.partitionBy("utm_source"))
    return cells.withColumn("channel_total", total)


def channel_by_show(
    tickets: Tickets, f: Filters, channels: Sequence[str] | None = None
) -> DataFrame:
    """Show by channel; zeros for the ``channels`` named."""
    tickets.require("utm_source")
    cells = (
        kept_online(tickets, f)
        .filter(F.col("event_name").isNotNull() & F.col("utm_source").isNotNull())
        .groupBy("event_name", "utm_source")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    if channels is None:
        return cells
    return grids.dense(cells, "event_name", "utm_source", "tickets", channels)


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every acquisition chart that the input's columns and the selection allow, from one scan."""
    if not tickets.has("utm_source"):
        return {}
    source, event = F.col("utm_source"), F.col("event_name")
    counts = in_kept(f, tickets) & is_online() & source.isNotNull()
    groupings = {"by_channel": Grouping(counts, {"utm_source": source})}
    if tickets.has("utm_medium"):
        medium = F.col("utm_medium")
        keys = {"utm_source": source, "utm_medium": medium}
        groupings["channel_by_medium"] = Grouping(counts & medium.isNotNull(), keys)
    if f.is_multi(tickets):
        keys = {"event_name": event, "utm_source": source}
        groupings["channel_by_show"] = Grouping(counts & event.isNotNull(), keys)
    out = together(selected(tickets, f), groupings, {"tickets": F.count(F.lit(1))})
    out["by_channel"] = out["by_channel"].orderBy("tickets", "utm_source")
    if "channel_by_medium" in out:
        total = F.sum("tickets").over(Window.partitionBy("utm_source"))
        out["channel_by_medium"] = out["channel_by_medium"].withColumn("channel_total", total)
    return out

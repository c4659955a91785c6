"""Door sales: the ledger as ticket rows, and door against online."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import constants as C
from turnstile import schema as S
from turnstile.filters import Filters, in_kept, in_selection, is_online
from turnstile.frame import Tickets
from turnstile.functions.money import revenue_cents


_PART = 10_000
_PRICES = T.ArrayType(S.PRICE)


def _zero():
    return F.lit(0).cast("long")


def door_rows(
    ledger: DataFrame, online: Tickets | None, as_of: date, prices: DataFrame | None = None
) -> DataFrame:
    """One row per door ticket of every ledger entry.

    The order date is the entry's own, else the day its show first starts, else
    ``as_of``. Listed prices hold only if there is one per ticket, be it in the entry
    or in the table ``prices`` (entry_id, position, price); otherwise each ticket carries an equal
    share of the entry's revenue, and the first one also what rounding leaves, so that
    shares add up to the revenue. An entry can stand for any number of tickets, so
    entries are cut into parts of bounded size and the parts spread evenly before they
    become rows.
    """
    entries = ledger.withColumn("n", F.col("tickets").cast("int"))
    if online is not None and online.has("event_start_time"):
        starts = (
            online.rows.filter(F.col("event_name").isNotNull())
            .groupBy("event_name")
            .agg(F.to_date(F.min("event_start_time")).alias("show_date"))
        )
        entries = entries.join(starts, "event_name", "left")
    else:
        entries = entries.withColumn("show_date", F.lit(None).cast("date"))

    kept = [c for c in ledger.columns if c in ("tenant_id", "entry_id")]
    day = F.coalesce("entry_date", "show_date", F.lit(as_of)).alias("order_date")
    ticket = [
        *kept,
        "event_name",
        F.lit(C.VALID).alias("ticket_status"),
        F.lit(C.DOOR).alias("source"),
        "order_date",
    ]
    priced = None
    if prices is not None:
        numbers = prices.groupBy("entry_id").agg(
            F.count(F.lit(1)).alias("n_prices"), F.max("position").alias("last_position")
        )
        entries = entries.join(numbers, "entry_id", "left")
        whole = F.col("n_prices").eqNullSafe(F.col("n").cast("long"))
        # Both sides are cut at the same positions, so the prices of one show meet it in many tasks.
        ranges = F.sequence(F.lit(0).cast("long"), F.floor(F.col("last_position") / _PART))
        of_range = prices.select(
            "entry_id",
            F.floor(F.col("position") / _PART).alias("part"),
            F.col("price").alias("door_price"),
        )
        priced = (
            entries.filter(whole & (F.col("n") > 0))
            .select(*kept, "event_name", day, F.explode(ranges).alias("part"))
            .join(of_range, ["entry_id", "part"])
            .select(*ticket, "door_price")
        )
        entries = entries.filter(~whole).drop("n_prices", "last_position")

    n, own, first = F.col("n"), F.col("prices"), F.col("part") * _PART
    listed = own.isNotNull() & (F.size(own) == n)
    share = (F.col("revenue_brl") / n).cast(S.PRICE)
    rest = (F.col("revenue_brl") - share * n).cast(S.PRICE)
    size = F.least(F.lit(_PART), n - first)
    parts = (
        entries.filter(n > 0)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _PART).cast("int"))))
        .select(
            *kept,
            "event_name",
            day,
            size.alias("size"),
            F.when(listed, F.slice(own, first + 1, size)).cast(_PRICES).alias("own_prices"),
            F.when(~listed, share).alias("share"),
            F.when(F.col("part") == 0, share + rest).otherwise(share).cast(S.PRICE).alias("lead"),
        )
        .hint("rebalance")
    )
    shares = F.concat(F.array("lead"), F.array_repeat("share", F.col("size") - 1)).cast(_PRICES)
    out = parts.select(*ticket, F.explode(F.coalesce("own_prices", shares)).alias("door_price"))
    return out if priced is None else out.unionByName(priced)


def all_channels(online: Tickets, door: DataFrame) -> Tickets:
    """Online tickets and door rows in one frame; what a channel lacks is null."""
    rows = online.rows.unionByName(door, allowMissingColumns=True)
    brl = F.coalesce(F.col("deal_price_brl").cast(S.PRICE), F.col("door_price"))
    rows = rows.withColumn("deal_price_brl", brl)
    return Tickets(rows, online.present | set(door.columns) | {"door_price", "deal_price_brl"})


def _ledger_cents():
    return F.round(F.coalesce(F.sum("revenue_brl"), F.lit(0)) * 100).cast("long")


def door_totals(ledger: DataFrame, f: Filters | None = None) -> DataFrame:
    """Tickets and revenue per show straight from the ledger."""
    entries = ledger.filter(F.col("event_name").isNotNull())
    if f is not None:
        entries = entries.filter(in_selection(f))
    return entries.groupBy("event_name").agg(
        F.coalesce(F.sum(F.col("tickets").cast("long")), _zero()).alias("tickets"),
        _ledger_cents().alias("revenue_cents"),
    )


def online_totals(tickets: Tickets, f: Filters) -> DataFrame:
    """Rows and revenue per show of the online sales kept by the filters."""
    rows = tickets.rows.filter(in_kept(f, tickets) & is_online())
    return rows.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("tickets"), revenue_cents(tickets).alias("revenue_cents")
    )


def channel_comparison(tickets: Tickets, ledger: DataFrame, f: Filters) -> DataFrame:
    """Both channels per show, 0 where one has nothing; dates do not limit the ledger.

    Per-show totals are stacked and summed again, which gives the full outer join
    without joining.
    """
    online = online_totals(tickets, f).select(
        "event_name",
        F.col("tickets").alias("online_tickets"),
        F.col("revenue_cents").alias("online_cents"),
        _zero().alias("door_tickets"),
        _zero().alias("door_cents"),
    )
    door = door_totals(ledger, f).select(
        "event_name",
        _zero().alias("online_tickets"),
        _zero().alias("online_cents"),
        F.col("tickets").alias("door_tickets"),
        F.col("revenue_cents").alias("door_cents"),
    )
    measures = online.columns[1:]
    return (
        online.unionByName(door)
        .groupBy("event_name")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def _by_channel(online: str, door: str, value: str):
    return F.array(
        F.struct(F.lit(C.ONLINE).alias("channel"), F.col(online).alias(value)),
        F.struct(F.lit(C.DOOR).alias("channel"), F.col(door).alias(value)),
    )


def channel_grand_totals(tickets: Tickets, ledger: DataFrame, f: Filters) -> DataFrame:
    """Tickets and revenue of each channel over all shows."""
    comparison = channel_comparison(tickets, ledger, f)
    totals = comparison.agg(
        *[F.coalesce(F.sum(m), _zero()).alias(m) for m in comparison.columns[1:]]
    )
    return totals.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(C.ONLINE).alias("channel"),
                    F.col("online_tickets").alias("tickets"),
                    F.col("online_cents").alias("revenue_cents"),
                ),
                F.struct(
                    F.lit(C.DOOR).alias("channel"),
                    F.col("door_tickets").alias("tickets"),
                    F.col("door_cents").alias("revenue_cents"),
                ),
            )
        )
    )


def channel_revenue_long(comparison: DataFrame) -> DataFrame:
    """Revenue in cents per show and channel."""
    cells = _by_channel("online_cents", "door_cents", "value")
    return comparison.select("event_name", F.inline(cells))


def channel_tickets_long(comparison: DataFrame) -> DataFrame:
    """Tickets per show and channel."""
    cells = _by_channel("online_tickets", "door_tickets", "value")
    return comparison.select("event_name", F.inline(cells))


def bundle(tickets: Tickets, ledger: DataFrame, f: Filters) -> dict[str, DataFrame]:
    """Every door-against-online chart; only with both channels selected."""
    if not {C.ONLINE, C.DOOR} <= set(f.channels):
        return {}
    comparison = channel_comparison(tickets, ledger, f)
    return {
        "comparison": comparison,
        "grand_totals": channel_grand_totals(tickets, ledger, f),
        "revenue": channel_revenue_long(comparison),
        "tickets": channel_tickets_long(comparison),
    }

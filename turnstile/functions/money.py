"""Price expressions shared by the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.frame import Tickets


def price(tickets: Tickets) -> Column:
    """A ticket's price in cents; door prices may be fractions of a cent."""
    if tickets.has_door:
        return F.coalesce(
            F.col("deal_price_cents").cast("decimal(22,4)"), F.col("door_price") * 100
        )
    return F.col("deal_price_cents")


def revenue_cents(tickets: Tickets, where: Column | None = None) -> Column:
    """Sum of prices in whole cents, 0 over no prices; door fractions round after the sum."""

    def total(col: Column) -> Column:
        return F.sum(col if where is None else F.when(where, col))

    cents = F.coalesce(total(F.col("deal_price_cents")), F.lit(0).cast("long"))
    if not tickets.has_door:
        return cents
    door = F.round(F.coalesce(total(F.col("door_price")), F.lit(0)) * 100).cast("long")
    return cents + door


def paid_or_free(tickets: Tickets) -> Column:
    """By-zero rule: only an exact zero is free, an unknown price counts as paid."""
    return F.when(price(tickets) == 0, C.FREE).otherwise(C.PAID)


def category(tickets: Tickets) -> Column:
    """By-positive rule: the title of tickets with a price above zero, else free."""
    return F.when(price(tickets) > 0, F.col("deal_title")).otherwise(C.FREE)


def is_paid(tickets: Tickets) -> Column:
    """Price above zero; an unknown price is not."""
    return F.coalesce(price(tickets) > 0, F.lit(False))

"""Who buys online: one row per buyer, and how often buyers return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.filters import Filters, kept_online
from turnstile.frame import Tickets
from turnstile.functions.normalise import known_city, known_gender, loyalty_label
from turnstile.operators import grids
from turnstile.session import shared_dir, written


def _earliest() -> Column:
    """Order of a buyer's rows: dated before undated, then by time, then by ticket."""
    ordered = F.col("ordered_at")
    return F.struct(ordered.isNull(), ordered, F.col("ticket_id"))


def unique_buyers(tickets: Tickets, f: Filters, *columns: str) -> DataFrame:
    """The first row of every buyer, unknown buyers together as one.

    An aggregate rather than a ranking, so every task shrinks its rows to one per
    buyer before the shuffle, however many tickets a single buyer holds.
    """
    sales = kept_online(tickets, f)
    picked = [c for c in (columns or sales.columns) if c != "contact_id"]
    if not tickets.has("contact_id"):
        # Without buyers every ticket stands for itself.
        return sales.select("contact_id", *picked)
    first = F.min_by(F.struct(*picked), _earliest())
    return sales.groupBy("contact_id").agg(first.alias("first")).select("contact_id", "first.*")


def _labelled_counts(labels: DataFrame) -> DataFrame:
    return (
        labels.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("buyers"))
    )


def gender(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers per stated gender."""
    tickets.require("contact_gender")
    buyers = unique_buyers(tickets, f, "contact_gender")
    return _labelled_counts(buyers.select(known_gender(F.col("contact_gender")).alias("label")))


def _in_age_range() -> Column:
    return F.col("age").between(C.AGE_FIRST, C.AGE_LAST)


def age(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers per year of age over the whole chart range, zeros included."""
    tickets.require("age")
    counts = (
        unique_buyers(tickets, f, "age")
        .filter(_in_age_range())
        .groupBy(F.col("age").cast("long").alias("age"))
        .agg(F.count(F.lit(1)).alias("buyers"))
    )
    ages = counts.sparkSession.range(C.AGE_FIRST, C.AGE_LAST + 1).select(F.col("id").alias("age"))
    return grids.with_zero_keys(counts, ages, "age", "buyers")


def top_cities(tickets: Tickets, f: Filters) -> DataFrame:
    """The fifteen most frequent cities."""
    tickets.require("contact_locality")
    buyers = unique_buyers(tickets, f, "contact_locality")
    counts = _labelled_counts(buyers.select(known_city(F.col("contact_locality")).alias("label")))
    return counts.orderBy(F.desc("buyers"), "label").limit(C.TOP_CITIES)


def optin(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers by newsletter choice; unknown choices are left out."""
    flag = F.col("contact_newsletter_optin")
    tickets.require("contact_newsletter_optin")
    label = F.when(flag, C.SUBSCRIBED).when(~flag, C.NOT_SUBSCRIBED)
    buyers = unique_buyers(tickets, f, "contact_newsletter_optin")
    return _labelled_counts(buyers.select(label.alias("label")))


def _shows_per_buyer(tickets: Tickets, f: Filters) -> DataFrame:
    tickets.require("contact_id", "event_id")
    return (
        kept_online(tickets, f)
        .filter(F.col("contact_id").isNotNull())
        .groupBy("contact_id")
        .agg(F.count_distinct("event_id").alias("n_shows"))
    )


def recurrence(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers by number of distinct shows."""
    return (
        _shows_per_buyer(tickets, f)
        .groupBy("n_shows")
        .agg(F.count(F.lit(1)).alias("buyers"))
        .select("n_shows", loyalty_label(F.col("n_shows")).alias("label"), "buyers")
    )


def top_loyal(tickets: Tickets, f: Filters) -> DataFrame:
    """The ten buyers with most shows, labelled by the name on their first row, else their id.

    One scan: rows shrink to one per buyer and show with its earliest name, then to one per
    buyer.
    """
    own_id = F.col("contact_id").cast("string")
    named = next((c for c in ("contact_name", "contact_email") if tickets.has(c)), None)
    if named is None:
        shows, label = _shows_per_buyer(tickets, f), own_id
    else:
        tickets.require("contact_id", "event_id")
        per_show = (
            kept_online(tickets, f)
            .filter(F.col("contact_id").isNotNull())
            .groupBy("contact_id", "event_id")
            .agg(
                F.min(_earliest()).alias("at"),
                F.min_by(F.struct(named), _earliest()).alias("first"),
            )
        )
        shows = per_show.groupBy("contact_id").agg(
            F.count("event_id").alias("n_shows"), F.min_by("first", "at").alias("first")
        )
        label = F.coalesce(F.col(f"first.{named}"), own_id)
    best = shows.orderBy(F.desc("n_shows"), "contact_id").limit(C.TOP_BUYERS)
    return best.select("contact_id", label.alias("label"), "n_shows")


def age_by_gender(tickets: Tickets, f: Filters) -> DataFrame:
    """Buyers per gender and year of age, zeros included for every gender that occurs."""
    tickets.require("age", "contact_gender")
    cells = (
        unique_buyers(tickets, f, "age", "contact_gender")
        .select(known_gender(F.col("contact_gender")).alias("gender"), "age")
        .filter(F.col("gender").isNotNull() & _in_age_range())
        .groupBy("gender", "age")
        .agg(F.count(F.lit(1)).alias("buyers"))
    )
    return grids.with_age_range(cells, "gender", "buyers")


#: What the metrics of this module read of a row.
_READ = (
    *("event_name", "ticket_status", "source", "ordered_at", "order_date", "ticket_id", "age"),
    *("contact_name", "contact_email", "contact_gender", "contact_locality"),
    "contact_newsletter_optin",
)


def _first_rows(tickets: Tickets, f: Filters) -> Tickets:
    """The first kept row of every buyer and show, written once.

    Every metric here asks for a buyer's first row or different shows, which these rows answer
    as all rows do. Without buyers, or a shared folder, the tickets stay as they are.
    """
    if not tickets.has("contact_id") or shared_dir(tickets.rows.sparkSession) is None:
        return tickets
    rows = kept_online(tickets, f)
    keys = [c for c in ("contact_id", "event_id") if c in rows.columns]
    first = F.min_by(F.struct(*[c for c in _READ if c in rows.columns]), _earliest())
    reduced = rows.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")
    return Tickets(written(reduced, "first_rows"), tickets.present)


def bundle(tickets: Tickets, f: Filters) -> dict[str, DataFrame]:
    """Every audience chart that the input's columns and the selection allow, from one scan."""
    multi = f.is_multi(tickets)
    wanted: dict[str, Callable[[Tickets, Filters], DataFrame]] = {}
    if tickets.has("contact_gender"):
        wanted["gender"] = gender
    if tickets.has("age"):
        wanted["age"] = age
    if tickets.has("contact_locality"):
        wanted["top_cities"] = top_cities
    if tickets.has("contact_newsletter_optin"):
        wanted["optin"] = optin
    if tickets.has("event_id", "contact_id") and multi:
        wanted["recurrence"], wanted["top_loyal"] = recurrence, top_loyal
    if tickets.has("age", "contact_gender"):
        wanted["age_by_gender"] = age_by_gender
    if not wanted:
        return {}
    first_rows = _first_rows(tickets, f)
    return {name: metric(first_rows, f) for name, metric in wanted.items()}

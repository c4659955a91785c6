"""Show, channel and date selection, and the three row scopes it defines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.frame import Tickets


def _bound(value: str | date | None) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    if value is None or isinstance(value, date):
        return value
    try:
        return datetime.fromisoformat(value).date()
    except ValueError:
        return None


@dataclass(frozen=True)
class Filters:
    """An empty ``events`` selects every named show; dates count only as a pair."""

    events: tuple[str, ...] = ()
    channels: tuple[str, ...] = (C.ONLINE,)
    date_from: date | None = None
    date_to: date | None = None
    ref_event: str | None = None

    @classmethod
    def of(cls, events=(), channels=(), date_from=None, date_to=None, ref_event=None) -> Filters:
        return cls(
            events=tuple(dict.fromkeys(events or ())),
            channels=tuple(channels or ()) or (C.ONLINE,),
            date_from=_bound(date_from),
            date_to=_bound(date_to),
            ref_event=ref_event or None,
        )

    @property
    def date_range(self) -> tuple[date, date] | None:
        if self.date_from and self.date_to:
            return self.date_from, self.date_to
        return None

    def is_multi(self, tickets: Tickets) -> bool:
        """More than one show selected; only an open selection has to look at the data."""
        if self.events:
            return len(self.events) > 1
        # Two looks that each stop at the first hit, rather than a distinct over everything.
        name = F.col("event_name")
        names = tickets.rows.select(name).filter(name.isNotNull())
        first = names.first()
        return first is not None and not names.filter(name != first[0]).isEmpty()


# The predicates below may be null where a name or channel is; a null counts as false in
# filters and conditional counts alike. Left bare, they can be pushed down to the scan.


def in_selection(f: Filters) -> Column:
    """Show selected."""
    name = F.col("event_name")
    return name.isin(list(f.events)) if f.events else name.isNotNull()


def in_kept(f: Filters, tickets: Tickets) -> Column:
    """Selected, not canceled (an unknown status is kept), channel and dates matching."""
    kept = (
        in_selection(f)
        & ~F.col("ticket_status").eqNullSafe(C.CANCELED)
        & F.col("source").isin(list(f.channels))
    )
    if f.date_range and tickets.has("order_date"):
        kept = kept & _within(*f.date_range, tickets)
    return kept


def _within(low: date, high: date, tickets: Tickets) -> Column:
    """Order date between two days, both included."""
    # Online tickets have a moment, whose bounds a scan can use; door tickets have a day.
    ordered = F.col("ordered_at")
    first = F.lit(low).cast("timestamp")
    after = F.date_add(F.lit(high), 1).cast("timestamp")
    moment = (ordered >= first) & (ordered < after)
    if not tickets.has_door:
        return moment
    day = F.col("order_date").between(F.lit(low), F.lit(high))
    return (is_online() & moment) | (~is_online() & day)


def is_online() -> Column:
    return F.col("source") == C.ONLINE


def selected(tickets: Tickets, f: Filters) -> DataFrame:
    """Rows of the selected shows: keeps canceled ones, ignores channel and dates."""
    return tickets.rows.filter(in_selection(f))


def kept(tickets: Tickets, f: Filters) -> DataFrame:
    """Rows that count as sales under the filters."""
    return tickets.rows.filter(in_kept(f, tickets))


def kept_online(tickets: Tickets, f: Filters) -> DataFrame:
    """Kept rows of the online channel."""
    return tickets.rows.filter(in_kept(f, tickets) & is_online())

"""Hand-made ticket frames."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import types as T

from turnstile import Tickets

AS_OF = date(2024, 6, 1)
_TYPES = {
    "deal_price": T.LongType(),
    "ordered_at": T.TimestampType(),
    "event_start_time": T.TimestampType(),
    "ticket_scanned_at": T.TimestampType(),
    "contact_newsletter_optin": T.BooleanType(),
    "event_id": T.LongType(),
}


def at(text: str) -> datetime:
    """A UTC moment; a trailing offset is spelled out for the session."""
    return datetime.fromisoformat(text + "+00:00")


def raw(spark, columns: str, rows):
    names = columns.split()
    schema = T.StructType([T.StructField(n, _TYPES.get(n, T.StringType())) for n in names])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def tickets(spark, columns: str, rows, as_of=AS_OF) -> Tickets:
    return Tickets.from_raw(raw(spark, columns, rows), as_of)


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r])

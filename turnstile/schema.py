"""Column contracts of the two tables: tickets and the door ledger."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMPS = [
    "ordered_at",
    "event_start_time",
    "event_end_time",
    "ticket_scanned_at",
    "ticket_canceled_at",
    "event_published_at",
]
MONEY = ["deal_price", "deal_user_service_fee", "deal_producer_cost"]
TEXT = [
    "ticket_id",
    "event_id",
    "event_name",
    "ticket_status",
    "contact_id",
    "contact_name",
    "contact_email",
    "contact_gender",
    "contact_locality",
    "deal_title",
    "payment_method",
    "utm_source",
    "utm_medium",
]

# A ticket as it arrives in a JSON record: every field optional, typed later
# by the normaliser, so that one bad value never loses the record.
RAW_TICKET = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.StringType()) for c in TIMESTAMPS]
    + [T.StructField("contact_birthday", T.StringType())]
    + [T.StructField("contact_newsletter_optin", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in MONEY]
)

# Six places hold a price that is a share of a batch's revenue.
PRICE = T.DecimalType(18, 6)

LEDGER = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("tickets", T.IntegerType()),
        T.StructField("revenue_brl", PRICE),
        T.StructField("prices", T.ArrayType(PRICE)),
        T.StructField("entry_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
    ]
)

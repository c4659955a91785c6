"""What there is to filter on: shows, dates, channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.frame import Tickets


def summary(tickets: Tickets) -> DataFrame:
    """Long form (kind, value): every show, every channel, first and last order date.

    One pass: rows shrink to distinct (show, channel) pairs with their date range
    before anything is spread out into the long form.
    """
    pairs = tickets.rows.groupBy("event_name", "source").agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last")
    )
    marks = pairs.select(
        F.explode(
            F.array(
                F.struct(F.lit("event").alias("kind"), F.col("event_name").alias("label")),
                F.struct(F.lit("channel").alias("kind"), F.col("source").alias("label")),
                F.struct(F.lit("date_min").alias("kind"), F.lit("").alias("label")),
                F.struct(F.lit("date_max").alias("kind"), F.lit("").alias("label")),
            )
        ).alias("mark"),
        "first",
        "last",
    )
    return (
        marks.groupBy("mark.kind", "mark.label")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            "kind",
            F.when(F.col("kind") == "date_min", F.col("first").cast("string"))
            .when(F.col("kind") == "date_max", F.col("last").cast("string"))
            .otherwise(F.col("label"))
            .alias("value"),
        )
        .filter(F.col("value").isNotNull())
    )


def show_catalogue(tickets: Tickets) -> DataFrame:
    """Distinct (id, name) of shows by name."""
    rows = tickets.require("event_id", "event_name")
    return rows.select("event_id", "event_name").distinct().orderBy("event_name", "event_id")


def dataset_counts(tickets: Tickets) -> DataFrame:
    """Rows by origin."""
    return (
        tickets.rows.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )

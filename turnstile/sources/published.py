"""Normalised tickets written once and queried often."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnstile.frame import Tickets
from turnstile.functions.normalise import with_fillers


def publish(tickets: Tickets, path: str, files: int | None = None) -> None:
    """Write the columns that rest on real input, rows of a show next to each other.

    Files hold ranges of (show, hash of the ticket), so that a selection of shows
    skips row groups by their bounds while a show with most of the rows still
    spreads over many files. The path has to be one that every executor reaches.
    """
    columns = [c for c in tickets.rows.columns if c in tickets.present]
    rows = tickets.rows.select(*columns)
    spread = ["event_name", F.xxhash64("ticket_id")]
    ranged = (
        rows.repartitionByRange(*spread) if files is None else rows.repartitionByRange(files, *spread)
    )
    ranged.sortWithinPartitions("event_name").write.mode("errorifexists").parquet(path)


def open_published(spark: SparkSession, path: str) -> Tickets:
    """The published tickets; columns the input never had come back as fillers."""
    rows = spark.read.parquet(path)
    return Tickets(with_fillers(rows), frozenset(rows.columns))

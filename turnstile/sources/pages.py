"""Landed pages of the ticket API: one JSON file per page.

A page is ``{"cursor": <after it was asked with>, "data": [ticket, ...],
"pagination": {"next": <url with ?after=> or null}}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import schema as S
from turnstile.session import written
from turnstile.sources import chain

# Tickets stay JSON text here: a field nobody knows yet must reach the store too.
PAGE = "cursor string, data array<string>, pagination struct<next: string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page. A page that is cut off or malformed fails the read:
    taken as empty, its tickets would be lost without a trace."""
    return landed(spark.read.schema(PAGE).json(path, multiLine=True, mode="FAILFAST"))


def landed(files: DataFrame) -> DataFrame:
    """Pages of a batch or stream of page files."""
    return pages(files.select(F.col("_metadata.file_path").alias("page_file"), "*"))


def pages(rows: DataFrame) -> DataFrame:
    """Page file, its own cursor, its tickets and the cursor of the page after it."""
    following = F.try_parse_url(F.col("pagination.next"), F.lit("QUERY"), F.lit("after"))
    return rows.select(
        "page_file",
        "cursor",
        F.coalesce("data", F.array().cast("array<string>")).alias("data"),
        following.alias("next_cursor"),
    )


def records(page_rows: DataFrame) -> DataFrame:
    """One row per ticket with its id, its JSON text and where it stood.

    Pages that were walked (``chain.walk``) also give their place on the chain.
    """
    place = [c for c in ("arrival", "page_file") if c in page_rows.columns]
    rows = page_rows.select(*place, F.posexplode("data").alias("position", "raw"))
    ticket_id = F.get_json_object("raw", "$.ticket_id")
    return rows.select(ticket_id.alias("ticket_id"), "raw", *place, "position")


def pull(spark: SparkSession, path: str) -> DataFrame:
    """The tickets of the pages that a client following the cursors would get, in that order.

    Pages that lie in the folder but that no walked page leads to are left out;
    ``chain.audit`` names them.
    """
    # Parsed once, for the walk and for the tickets.
    return records(chain.walk(written(read_pages(spark, path), "pages", "zstd")))


def chain_gaps(page_rows: DataFrame) -> DataFrame:
    """Cursors that were announced but never landed, or landed more than once.

    An empty page ends the chain, whatever it announces. Every page yields both of
    its cursors, so one scan and one shuffle answer both questions.
    """
    def mark(cursor, announced: int, landed: int):
        return F.struct(
            cursor.alias("cursor"),
            F.lit(announced).cast("long").alias("announced"),
            F.lit(landed).cast("long").alias("landed"),
        )

    following = F.when(F.size("data") > 0, F.col("next_cursor"))
    marks = F.array(mark(F.col("cursor"), 0, 1), mark(following, 1, 0))
    problem = F.when(F.col("landed") == 0, "missing").when(F.col("landed") > 1, "repeated")
    return (
        page_rows.select(F.inline(marks))
        .filter(F.col("cursor").isNotNull())
        .groupBy("cursor")
        .agg(F.sum("announced").alias("announced"), F.sum("landed").alias("landed"))
        .select("cursor", problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )


def parsed(rows: DataFrame) -> DataFrame:
    """The known fields of the JSON text next to the other columns, still as text."""
    kept = [c for c in rows.columns if c not in S.RAW_TICKET.fieldNames() and c != "raw"]
    # Unpacked by a generator: filters on the fields stay above it and do not parse again.
    flat = rows.select(*kept, "raw", F.inline(F.array(F.from_json("raw", S.RAW_TICKET))))
    # A JSON flag arrives as lower-case text, a quoted one as it was written.
    flag = F.col("contact_newsletter_optin")
    return flat.withColumn(
        "contact_newsletter_optin",
        F.when(flag == "true", "True").when(flag == "false", "False").otherwise(flag),
    )


def to_raw_json(tickets: DataFrame) -> DataFrame:
    """Every row as JSON text: NaN and infinities become null, times ISO 8601 in UTC."""
    fields = []
    for field in tickets.schema.fields:
        col, kind = F.col(field.name), field.dataType.typeName()
        if kind in ("double", "float"):
            col = F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
        elif kind in ("timestamp", "timestamp_ntz"):
            pattern = "yyyy-MM-dd'T'HH:mm:ss"
            zone = "xxx" if kind == "timestamp" else ""
            whole = F.date_format(col, pattern + zone)
            fine = F.date_format(col, pattern + ".SSSSSS" + zone)
            exact = F.date_trunc("second", col) == col
            col = F.when(exact, whole).otherwise(fine)
        fields.append(col.alias(field.name))
    raw = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return tickets.select(F.col("ticket_id").cast("string").alias("ticket_id"), raw.alias("raw"))

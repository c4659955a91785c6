"""Card-terminal statements: small CSV files with a preamble.

A statement is read whole, one row per file, because its header has to be found
by line number. A quoted cell may hold line breaks; its row has the number of its first line.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile import schema as S
from turnstile.functions.normalise import strip

# A comma outside double quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """The cells of a CSV line; only a line with quotes needs the slow way."""

    def bare(cell: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(cell, '^"([\\s\\S]*)"$', "$1"), '""', '"')

    quoted = F.transform(F.split(line, _COMMA, -1), bare)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _amount(cell: Column, decimal_comma: bool) -> Column:
    text = strip(cell)
    if decimal_comma:
        text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return text.try_cast(S.PRICE)


def sales(spark: SparkSession, path: str, decimal_comma: bool = False) -> DataFrame:
    """The sales of the statement files under ``path``."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    return sales_in(files, decimal_comma)


def sales_in(statements: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """One row per sale of the statements (file, text): file, line number, date, amount.

    Sales have the sale type, a positive amount and a valid date; everything else
    in the statement is left out.
    """
    # Told by the text, so that each statement is cut up in one of the two ways only.
    quoted = F.contains("text", F.lit('"'))
    plain = _bodies(statements.filter(~quoted))
    # Cut up inside the generator: filters on the cells stay above it and do not cut again.
    cells = F.transform("body", lambda line: F.split(line, ",", -1))
    numbered = plain.select("file", "header", F.posexplode(cells).alias("offset", "cells"))
    joined = _joined(_bodies(statements.filter(quoted)))
    numbered = numbered.unionByName(
        joined.select("file", "header", "offset", F.inline(F.array(F.struct(_cells(F.col("row")).alias("cells")))))
    )
    line_no = (F.col("offset") + C.STATEMENT_PREAMBLE_LINES + 1).alias("line_no")

    def named(column: str) -> Column:
        place = F.array_position("header", column)
        return F.when(place > 0, F.get("cells", place.cast("int") - 1))

    date_text = named(C.STATEMENT_DATE)
    return (
        numbered.select(
            "file",
            line_no,
            strip(named(C.STATEMENT_TYPE)).alias("kind"),
            F.to_date(F.try_to_timestamp(date_text, F.lit(C.STATEMENT_DATE_PATTERN))).alias(
                "sale_date"
            ),
            _amount(named(C.STATEMENT_AMOUNT), decimal_comma).alias("amount"),
        )
        .filter(
            (F.col("kind") == C.STATEMENT_SALE)
            & (F.col("amount") > 0)
            & F.col("sale_date").isNotNull()
        )
        .select("file", "line_no", "sale_date", "amount")
    )


def _bodies(statements: DataFrame) -> DataFrame:
    """The statements (file, text) as file, header cells and the lines below the preamble."""
    lines = F.split(F.col("text"), "\r\n|\n|\r", -1)
    filled = lambda line: F.trim(line) != ""
    return (
        statements.select(
            "file", F.slice(lines, C.STATEMENT_PREAMBLE_LINES + 1, F.size(lines)).alias("body")
        )
        .select("file", "body", F.get(F.filter("body", filled), 0).alias("header_line"))
        .select("file", "body", F.transform(_cells(F.col("header_line")), strip).alias("header"))
    )


def _joined(files: DataFrame) -> DataFrame:
    """The rows of the files (file, header, body of lines): lines between which a quote is open are one."""
    lines = files.select("file", "header", F.posexplode("body").alias("offset", "line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    by_file = Window.partitionBy("file").orderBy("offset")
    before, so_far = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.pmod(F.coalesce(F.sum(quotes).over(before), F.lit(0)), F.lit(2)) == 0
    marked = lines.withColumn("first", F.when(begins, F.col("offset")))
    parts = marked.withColumn("first", F.max("first").over(so_far)).groupBy("file", "first").agg(
        F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("lines")
    )
    row = F.array_join(F.transform("lines", lambda part: part["line"]), "\n").alias("row")
    return parts.select("file", "header", F.col("first").alias("offset"), row)


def _figures() -> list[Column]:
    """Count, sum and the prices in line order; a list never outgrows its one file."""
    pairs = F.array_sort(F.collect_list(F.struct("line_no", "amount")))
    return [
        F.count(F.lit(1)).alias("tickets"),
        F.sum("amount").cast(S.PRICE).alias("revenue_brl"),
        F.transform(pairs, lambda p: p["amount"]).alias("prices"),
    ]


def totals(sales_rows: DataFrame) -> DataFrame:
    """Figures per statement file."""
    return sales_rows.groupBy("file").agg(*_figures())


def one_show_entries(
    per_file: DataFrame, event_name: str, tenant: str, added_at: datetime
) -> DataFrame:
    """One ledger entry per statement, its figures of ``totals``, all for one show."""
    return per_file.select(
        F.lit(tenant).alias("tenant_id"),
        F.lit(event_name).alias("event_name"),
        F.col("tickets").cast("int").alias("tickets"),
        "revenue_brl",
        "prices",
        F.lit(None).cast("date").alias("entry_date"),
        F.lit(C.ORIGIN_STATEMENT).alias("source"),
        F.lit(added_at).alias("added_at"),
    )


def by_date(sales_rows: DataFrame) -> DataFrame:
    """Figures per statement file and sale date."""
    return sales_rows.groupBy("file", "sale_date").agg(*_figures())


def assigned_entries(
    dated: DataFrame, assignments: DataFrame, tenant: str, added_at: datetime
) -> DataFrame:
    """Ledger entries for the dates that ``assignments`` (sale_date, event_name) maps to a show.

    A date has one show: a date that is mapped to two raises when the entries are read, as it
    would double the day's sales. The same mapping twice is one.
    """
    wanted = assignments.filter(
        F.col("event_name").isNotNull() & (F.col("event_name") != C.IGNORED_SHOW)
    )
    twice = F.raise_error(F.concat(F.lit("date mapped to two shows: "), F.col("sale_date")))
    wanted = (
        wanted.groupBy("sale_date")
        .agg(F.min("event_name").alias("event_name"), F.max("event_name").alias("other"))
        .select(
            "sale_date",
            F.when(F.col("event_name") == F.col("other"), F.col("event_name"))
            .otherwise(twice.cast("string"))
            .alias("event_name"),
        )
    )
    return dated.join(wanted, "sale_date").select(
        F.lit(tenant).alias("tenant_id"),
        "event_name",
        F.col("tickets").cast("int").alias("tickets"),
        "revenue_brl",
        "prices",
        F.col("sale_date").alias("entry_date"),
        F.lit(C.ORIGIN_STATEMENT).alias("source"),
        F.lit(added_at).alias("added_at"),
    )

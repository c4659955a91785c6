"""Records of CSV files whose quoted cells hold line breaks, found in parallel.

A line begins a record if an even number of quotes stands before it in its file. Files are read in splits, so each split
says how many quotes it has, and for both cases, of an even and of an odd number before it, how many records begin in
it and where the last one does. Sums over the splits of a file, a row for each hundred megabytes, then tell
which case holds, and how many records came before. Lines that are a record each stay where they are; only those of
records of several lines are put together. In a file without quotes every line is a record, and none has to be put in
order to be numbered.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.session import shared_dir, written

#: Columns that say where a record stands: its file, and its number there.
PLACE = ("csv_file", "csv_position")

_SPLIT = ("file", "block")
#: Marks a line break inside a record while its lines are put together.
_BREAK = "\n"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, the start of its split and its place there."""
    return spark.read.text(path, lineSep=_BREAK).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Rises by one from line to line within a split.
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
    )


def _lines(spark: SparkSession, path: str, splits: DataFrame | None = None) -> DataFrame:
    """The lines, of all or some splits, with the quotes before them in their split, modulo 2."""
    text = _text(spark, path)
    if splits is not None:
        text = text.join(splits, list(_SPLIT))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    before = Window.partitionBy(*_SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    odd = text.withColumn("odd", F.pmod(quotes, F.lit(2)))
    return odd.withColumn("parity", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))


def _counted(text: DataFrame) -> DataFrame:
    """(file, block, first, lines, quoted) of every split: its first line, the lines before it in its file, and
    whether the file has quotes."""
    own = text.groupBy(*_SPLIT).agg(
        F.min("line").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.contains("text", F.lit('"'))).alias("own_quotes"),
    )
    of_file = Window.partitionBy("file")
    earlier = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(
        *_SPLIT,
        "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines"),
        F.max("own_quotes").over(of_file).alias("quoted"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, open, records, begun): whether a split begins inside a record, the number of records begun before
    it, and where the last of them begins."""

    def when(parity: int) -> list[Column]:
        begins = F.col("parity") == parity
        at = F.when(begins, F.struct("block", "line"))
        return [F.count_if(begins).alias(f"n_{parity}"), F.max(at).alias(f"last_{parity}")]

    own = lines.groupBy(*_SPLIT).agg(F.pmod(F.sum("odd"), F.lit(2)).alias("odd"), *when(0), *when(1))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2))
    known = own.withColumn("open", inside)
    pick = lambda name: F.when(F.col("open") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    return known.withColumn("n", pick("n")).withColumn("last", pick("last")).select(
        *_SPLIT,
        "open",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records"),
        F.last("last", ignorenulls=True).over(earlier).alias("begun"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, record) of the files under ``path``, with positions from 1 in each file.

    A record's lines are joined by a line break; a carriage return at its end is no part of it. Empty
    lines between records are records without text. A quote that is never closed makes the rest of the
    file one record; inside a cell that is not quoted, a quote sign has to be written as one that is.
    """
    text = _text(spark, path)
    # A row for each hundred megabytes, so the lines of files without quotes stay where they are read.
    splits = F.broadcast(_counted(text))
    plain = text.join(splits.filter("NOT quoted"), list(_SPLIT)).select(
        "file", (F.col("lines") + F.col("line") - F.col("first") + 1).alias("position"), F.col("text").alias("record")
    )
    lines = _lines(spark, path, splits.filter("quoted").select(*_SPLIT))
    placed = lines.join(_splits(lines), list(_SPLIT))
    begins = F.col("parity") == F.col("open")
    so_far = Window.partitionBy(*_SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(
        F.last(F.when(begins, F.struct("block", "line")), ignorenulls=True).over(so_far), "begun"
    )
    found = placed.select(
        "file",
        F.struct("block", "line").alias("at"),
        "text",
        start.alias("start"),
        (F.col("records") + F.sum(begins.cast("long")).over(so_far)).alias("position"),
        (begins & (F.col("odd") == 0)).alias("whole"),
    )
    whole = found.filter("whole").select("file", "position", F.col("text").alias("record"))
    several = (
        found.filter("NOT whole")
        .groupBy("file", "start")
        .agg(
            F.min("position").alias("position"),
            F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"),
        )
        .select("file", "position", F.array_join(F.transform("parts", lambda p: p["text"]), _BREAK).alias("record"))
    )
    both = plain.unionByName(whole).unionByName(several)
    return both.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Every column as text, named by the header that each file begins with; with ``place`` also `PLACE`.

    The same rows as a reader that takes each file in one task, from many tasks.
    """
    found = records(spark, path).filter(F.trim("record") != "")
    if shared_dir(spark) is not None:  # found once, for the header and for every use of the rows
        found = written(found, "records")
    headers = found.groupBy("file").agg(F.min(F.struct("position", "record")).alias("header"))
    first = headers.select("header.record").distinct().limit(2).collect()
    if len(first) > 1:
        raise ValueError(f"files of different headers under {path}")
    names = next(csv.reader([first[0]["record"]])) if first else []
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    kept = [F.col(own).alias(name) for own, name in zip(("file", "position"), PLACE)] if place else []
    if not names:
        return spark.createDataFrame([], "file string, position long").select(*kept)
    rows = found.join(headers, "file").filter(F.col("position") > F.col("header.position"))
    cells = F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true"})
    # Unpacked by a generator: filters on the cells stay above it and do not cut again.
    return rows.select(*kept, F.inline(F.array(cells)))

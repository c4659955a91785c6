"""Ticket CSV files, and the consolidated file of both channels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile import schema as S
from turnstile.filters import Filters, kept
from turnstile.frame import Tickets
from turnstile.sources import quoted

_FLAG = "contact_newsletter_optin"


def _read(spark: SparkSession, path: str, multi_line: bool, place: bool = False) -> DataFrame:
    """Every column as text: types are the normaliser's business. Either way files are read in pieces."""
    if multi_line or place:
        return quoted.read_csv(spark, path, place)
    return spark.read.csv(path, header=True, inferSchema=False, escape='"')


def load_csv(
    spark: SparkSession, path: str, as_of: date | datetime, multi_line: bool = True
) -> Tickets:
    """Read and normalise a ticket CSV.

    Without line breaks inside quotes ``multi_line`` can be turned off, which saves a shuffle.
    """
    return Tickets.from_raw(_read(spark, path, multi_line), as_of)


def export_consolidated(tickets: Tickets, f: Filters, path: str, full: bool = False) -> None:
    """Write the filtered rows of both channels, or with ``full`` all rows, as CSV."""
    rows = tickets.rows if full else kept(tickets, f)
    columns = [F.col(f"{c}_cents").alias(c) for c in S.MONEY]
    # The normaliser knows a flag by these texts, not by CSV's lower-case ones.
    flag = F.col(_FLAG)
    columns.append(F.when(flag, "True").when(~flag, "False").alias(_FLAG))
    plain = [c for c in rows.columns if not c.endswith("_cents") and c not in ("door_price", _FLAG)]
    columns += plain
    writer = rows.select(*columns).write.mode("errorifexists")
    writer.csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def import_consolidated(
    spark: SparkSession, path: str, as_of: date | datetime, tenant: str, added_at: datetime
) -> tuple[Tickets, DataFrame, DataFrame]:
    """(online tickets, door ledger entries, their prices in file order) of a consolidated CSV."""
    rows = _read(spark, path, True, place=True)
    return split_consolidated(rows, as_of, tenant, added_at, order=quoted.PLACE)


def split_consolidated(
    rows: DataFrame,
    as_of: date | datetime,
    tenant: str,
    added_at: datetime,
    order: tuple[str, str] | None = None,
) -> tuple[Tickets, DataFrame, DataFrame]:
    """(online tickets, door ledger entries, their prices) of consolidated rows.

    The door rows of a show become one ledger entry with their number and sum. Their prices
    come as a table of their own, (entry_id, position, price) with one row per ticket, so neither
    an entry nor the number of entries depends on how large a show is or how the file is cut.
    Positions count from 0 in each entry: in the order of the two columns of ``order`` (a file
    and a whole number within it), or by price where rows have no order.
    """
    if "source" not in rows.columns:
        raise ValueError("not a consolidated file: no column 'source'")
    own = list(order or ())
    online = rows.filter(F.col("source") == C.ONLINE).drop("source", *own)
    stamp = added_at.isoformat()
    door = rows.filter((F.col("source") == C.DOOR) & F.col("event_name").isNotNull()).select(
        F.sha2(F.concat_ws("\n", F.lit(tenant), F.lit(stamp), "event_name"), 256).alias("entry_id"),
        "event_name",
        F.col("deal_price_brl").try_cast(S.PRICE).alias("price"),
        *own,
    )
    entries = door.groupBy("entry_id", "event_name").agg(
        F.count(F.lit(1)).cast("int").alias("tickets"),
        F.coalesce(F.sum("price"), F.lit(0)).cast(S.PRICE).alias("revenue_brl"),
    )
    ledger = entries.select(
        "entry_id",
        F.lit(tenant).alias("tenant_id"),
        "event_name",
        "tickets",
        "revenue_brl",
        F.lit(None).cast("array<decimal(18,6)>").alias("prices"),
        F.lit(None).cast("date").alias("entry_date"),
        F.lit(C.ORIGIN_CONSOLIDATED).alias("source"),
        F.lit(added_at).alias("added_at"),
    )
    prices = _in_order(door, *order) if order else _by_price(door)
    return Tickets.from_raw(online, as_of), ledger, prices.select("entry_id", "position", "price")


_CHUNK = 10_000


def _in_order(door: DataFrame, file: str, place: str) -> DataFrame:
    """Door rows with their position in their entry, in the order of file and place.

    An entry is numbered in chunks of 10,000 places of a file: sums over the chunks' sizes say where
    each begins, so no task has more of an entry than a chunk, or a row for each of its chunks.
    """
    chunk = F.floor(F.col(place) / _CHUNK).alias("chunk")
    rows = door.select("entry_id", "price", F.col(file).alias("file"), F.col(place).alias("place"), chunk)
    sizes = rows.groupBy("entry_id", "file", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("entry_id").orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("entry_id", "file", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("entry_id", "file", "chunk").orderBy("place")
    numbered = rows.withColumn("number", F.row_number().over(within) - 1)
    placed = numbered.join(starts, ["entry_id", "file", "chunk"])
    return placed.withColumn("position", F.col("start") + F.col("number"))


def _by_price(door: DataFrame) -> DataFrame:
    """Door rows with their position in their entry, by price, unknown ones first.

    Equal prices of an entry are counted before they are numbered, and parted again in runs of 10,000.
    """
    counts = door.groupBy("entry_id", "price").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("entry_id").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_CHUNK).cast("long")))
    runs = starts.withColumn("first", first).hint("rebalance")
    last = F.least(F.col("n"), F.col("first") + _CHUNK) - 1
    return runs.withColumn("number", F.explode(F.sequence("first", last))).withColumn(
        "position", F.col("start") + F.col("number")
    )

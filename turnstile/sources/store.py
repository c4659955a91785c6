"""The ticket store: a Parquet table laid out by tenant and hash of the ticket id, typed columns next to the raw record.

Whether an id is known can be told from its bucket alone, so a batch reads and rewrites only the buckets that its own ids fall
into. How many rows a bucket has is written down whenever it is met; the others need not be counted.

The raw record is a variant: a field that no column holds can be asked for by its path without parsing text again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schema as S
from turnstile.frame import Tickets
from turnstile.functions import normalise as N
from turnstile.sources import ingest, pages

_TEXT = T.StringType()

SCHEMA = T.StructType(
    [T.StructField("ticket_id", T.StringType()), T.StructField("raw", T.VariantType())]
    + [T.StructField(c, T.StringType()) for c in S.TEXT if c != "ticket_id"]
    + [T.StructField(c, T.TimestampType()) for c in S.TIMESTAMPS]
    + [T.StructField(c, T.LongType()) for c in S.MONEY]
    + [
        T.StructField("contact_birthday", T.TimestampNTZType()),
        T.StructField("contact_newsletter_optin", T.BooleanType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)
_LAYOUT = [T.StructField("tenant_id", T.StringType()), T.StructField("id_bucket", T.IntegerType())]
_LAID_OUT = T.StructType([*SCHEMA.fields, *_LAYOUT])
_COUNTS = "tenant_id string, id_bucket int, n_rows long, noted_at timestamp"

# What a batch says of an id: not stored; stored by an earlier fetch, by one of the same time, or to stay as it is.
_NEW, _LATER, _SAME, _STALE = "new", "later", "same", "stale"
# Where a stored row lies; files of one write share their names between buckets.
_PLACE = {"file": "_metadata.file_name", "at": "_metadata.row_index"}
#: Up to so many rows are put together by bucket before they are written.
_FEW = 1_000_000
_MOST_WRITERS = 64


def checked_tenant(tenant: str) -> str:
    """A tenant id names a folder, so it may hold only plain characters."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", tenant):
        raise ValueError(f"not a tenant id: {tenant!r}")
    return tenant


def _variant(raw: Column) -> Column:
    """JSON text as a variant; text that is no JSON is kept as a text."""
    return F.coalesce(F.try_parse_json(raw), raw.cast("variant"))


def typed(records: DataFrame, fetched_at: datetime) -> DataFrame:
    """Records (ticket_id, raw) with the store's columns and, where refused, the reason.

    The record says its id itself; ``asked_id`` is the one it was given with.
    """
    rows = pages.parsed(records.select(F.col("ticket_id").alias("asked_id"), "ticket_id", "raw"))
    flag = N.optin(F.col("contact_newsletter_optin"), _TEXT)
    columns = [F.col(c) for c in ("ticket_id", "raw", *S.TEXT[1:])]
    columns += [N.utc_timestamp(F.col(c), _TEXT).alias(c) for c in S.TIMESTAMPS]
    columns += [N.cents(F.col(c), _TEXT).alias(c) for c in S.MONEY]
    columns += [
        N.local_timestamp(F.col("contact_birthday"), _TEXT).alias("contact_birthday"),
        flag.alias("contact_newsletter_optin"),
        F.lit(fetched_at).alias("fetched_at"),
        ingest.reject_reason(rows).alias("reject_reason"),
        F.col("asked_id"),
    ]
    return rows.select(*columns)


class TicketStore:
    """One writer per tenant at a time; Parquet itself does not check uniqueness."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` counts for a new table; an existing one keeps the number it was created with."""
        self.spark, self.path, self._buckets = spark, path, buckets
        self._known: int | None = None

    def create(self) -> TicketStore:
        """Make the table readable before its first append."""
        empty = self.spark.createDataFrame([], _LAID_OUT)
        empty.write.mode("append").partitionBy("tenant_id", "id_bucket").parquet(self.path)
        if self._read("_layout", "buckets int").isEmpty():
            layout = self.spark.createDataFrame([(self._buckets,)], "buckets int")
            layout.write.mode("append").parquet(f"{self.path}/_layout")
        return self

    def _read(self, folder: str, schema: str) -> DataFrame:
        """A table kept beside the tickets, where readers of the tickets do not look."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def buckets(self) -> int:
        if self._known is None:
            noted = self._read("_layout", "buckets int").first()
            self._known = noted["buckets"] if noted else self._buckets
        return self._known

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ticket_id"), F.lit(self.buckets)).cast("int").alias("id_bucket")

    def _laid_out(self, tenant: str) -> DataFrame:
        return ingest.tenant_rows(self.spark, self.path, checked_tenant(tenant), _LAID_OUT)

    def rows(self, tenant: str) -> DataFrame:
        """The stored rows of one tenant; other tenants' folders are not listed for reading."""
        return self._laid_out(tenant).drop("id_bucket")

    def met(self, tenant: str, buckets: Sequence[int]) -> DataFrame:
        """The stored rows of some buckets: a filter on partitions, so the others' files are not read."""
        return self._laid_out(tenant).filter(F.col("id_bucket").isin(list(buckets)))

    def lookup(self, tenant: str, ids: DataFrame) -> DataFrame:
        """The stored rows of the given ids (ticket_id), from their buckets alone."""
        keyed = ids.filter(F.col("ticket_id").isNotNull()).select("ticket_id", self._bucket())
        held = self.met(tenant, _distinct(keyed, "id_bucket"))
        return held.join(keyed, ["id_bucket", "ticket_id"], "left_semi").select(*SCHEMA.fieldNames())

    def fields(self, tenant: str, **paths: tuple[str, str]) -> DataFrame:
        """ticket_id and fields of the raw records: ``name=(path, type)``, as ``age=("$.buyer.age", "int")``.

        A field that is missing, or of another type that cannot be cast, is null.
        """
        picked = [F.try_variant_get("raw", path, kind).alias(n) for n, (path, kind) in paths.items()]
        return self.rows(tenant).select("ticket_id", *picked)

    def _staged(self, rows: DataFrame) -> DataFrame:
        """The rows written beside the table, where readers do not look, and read back.

        What is written twice must not be computed twice: the store changes in between.
        """
        folder = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def tickets(self, tenant: str, as_of: date | datetime) -> Tickets:
        """Normalised tickets of one tenant."""
        return Tickets.from_raw(self.rows(tenant).drop("raw", "fetched_at", "tenant_id"), as_of)

    def _noted(self, tenant: str) -> dict[int, int]:
        """Rows of each bucket as last noted; one number per bucket, so the list is bounded."""
        noted = self._read("_counts", _COUNTS).filter(F.col("tenant_id") == checked_tenant(tenant))
        last = noted.groupBy("id_bucket").agg(F.max_by("n_rows", "noted_at").alias("n_rows"))
        return {r["id_bucket"]: r["n_rows"] for r in last.collect()}

    def _note(self, tenant: str, counts: dict[int, int]) -> None:
        rows = [(tenant, b, n) for b, n in counts.items()]
        if rows:
            noted = self.spark.createDataFrame(rows, "tenant_id string, id_bucket int, n_rows long")
            noted.withColumn("noted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
                f"{self.path}/_counts"
            )

    def ingest(
        self,
        tenant: str,
        records: DataFrame,
        fetched_at: datetime,
        refresh: bool = False,
        quarantine: str | None = None,
    ) -> dict[str, int]:
        """Add the records (ticket_id, raw) whose id is unknown; return the two counts.

        Ids are compared before the JSON is parsed, so what is known already costs no
        parsing, and only with the ids of the buckets that the batch meets. Records move to
        others only where ids repeat, so the batch is read a few times: what is costly to
        find should be written down before. Refused records go to the ``quarantine`` folder.
        Running a batch again adds nothing.

        With ``refresh`` a record also replaces the stored row of its id, if it was fetched
        later (or at the same time and says something else); of a batch's records of one id
        the last counts. Where none is replaced, rows are added; else only buckets where a row
        changes are written anew, in full before the old ones go. An older fetch that is
        replayed changes nothing.

        Counts are noted for every bucket met, from what was read there. After a run that
        failed in between, they are right again once its batch has been replayed.
        """
        checked_tenant(tenant)
        position = [c for c in ("arrival", "page_file", "position") if c in records.columns]
        order = F.struct(*position) if position else None
        keyed = records.select("ticket_id", "raw", *position)
        with_id = keyed.filter(F.col("ticket_id").isNotNull())
        buckets = _distinct(with_id.select(self._bucket()), "id_bucket")
        before = dict.fromkeys(buckets, 0) | _per_bucket(self.met(tenant, buckets))
        n_existing = sum((self._noted(tenant) | before).values())

        verdicts = self._verdicts(tenant, with_id, before, fetched_at, refresh)
        tally = {(r["state"], r["repeated"]): r["n"] for r in verdicts.groupBy("state", "repeated").agg(
            F.count(F.lit(1)).alias("n")
        ).collect()}
        n_fresh = sum(n for (state, _), n in tally.items() if state != _STALE)
        fresh = self._fresh(tenant, with_id, order, verdicts, tally, refresh).select("ticket_id", "raw")
        typed_rows = typed(fresh, fetched_at).withColumn("id_bucket", self._bucket())
        if quarantine is not None:
            nameless = keyed.filter(F.col("ticket_id").isNull()).select(
                "ticket_id", "raw", F.lit(ingest.NO_ID).alias("reject_reason")
            )
            refused = typed_rows.filter(F.col("reject_reason").isNotNull())
            refused = refused.select("ticket_id", "raw", "reject_reason").unionByName(nameless)
            ingest.quarantine(refused, quarantine)
        taken = F.col("reject_reason").isNull()
        if refresh:
            taken = taken & (F.col("asked_id") == F.col("ticket_id"))
        accepted = typed_rows.filter(taken).drop("reject_reason", "asked_id")
        accepted = accepted.withColumn("raw", _variant(F.col("raw")))
        if any(state in (_LATER, _SAME) for state, _ in tally):
            gone = verdicts.filter((F.col("state") == _LATER) & ~F.col("repeated"))
            spared = self._staged(typed_rows.filter(~F.coalesce(taken, F.lit(False))).select("asked_id"))
            gone = gone.join(spared, F.col("ticket_id") == F.col("asked_id"), "left_anti")
            if any(state == _SAME or (repeated and state == _LATER) for state, repeated in tally):
                compared = (F.col("state") == _SAME) | (F.col("repeated") & (F.col("state") == _LATER))
                compared = verdicts.filter(compared)
                gone = gone.unionByName(compared.join(accepted.select("ticket_id"), "ticket_id", "left_semi"))
            self._replace(tenant, accepted, gone, sum(before.values()) + n_fresh)
        elif n_fresh:
            self._write(tenant, accepted, "append", n_fresh)
        after = dict.fromkeys(buckets, 0) | (_per_bucket(self.met(tenant, buckets)) if n_fresh else before)
        self._note(tenant, after)
        return {"n_new": sum(after.values()) - sum(before.values()), "n_existing": n_existing}

    def _verdicts(
        self, tenant: str, with_id: DataFrame, before: dict[int, int], fetched_at: datetime, refresh: bool
    ) -> DataFrame:
        """What becomes of each id of a batch: (state, repeated, ticket_id), the id only where a record is not simply added.

        With ``refresh`` also where the stored row of the id lies: (file, at).

        Only ids are compared, so the records stay where they are. A fetch is small beside the store:
        its ids can be broadcast where Spark finds them small, and the ids of the buckets it meets are
        then read but not shuffled.
        """
        ids = with_id.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n"))
        if not any(before.values()):
            return self._staged(ids.select(
                F.when(F.col("n") > 1, F.col("ticket_id")).alias("ticket_id"),
                F.lit(_NEW).alias("state"),
                (F.col("n") > 1).alias("repeated"),
            ))
        place = list(_PLACE) if refresh else []
        met = self.met(tenant, list(before)).select(
            "ticket_id", F.col("fetched_at").alias("held_at"), *[F.col(_PLACE[c]).alias(c) for c in place]
        )
        # Both joins ask for the same of the batch, so its ids are shuffled once.
        held = met.join(ids, "ticket_id").select("ticket_id", "held_at", F.col("n").alias("held_n"), *place)
        now = F.lit(fetched_at)
        known = F.lit(_STALE)
        if refresh:
            later = F.col("held_at").isNull() | (F.col("held_at") < now)
            known = F.when(later, _LATER).when(F.col("held_at") == now, _SAME).otherwise(_STALE)
        state = F.when(F.col("held_n").isNull(), _NEW).otherwise(known)
        said = ids.join(held, "ticket_id", "left").select(
            "ticket_id", state.alias("state"), (F.coalesce("held_n", "n") > 1).alias("repeated"), *place
        )
        simple = (F.col("state") == _NEW) & ~F.col("repeated")
        return self._staged(said.withColumn("ticket_id", F.when(~simple, F.col("ticket_id"))))

    def _fresh(
        self,
        tenant: str,
        with_id: DataFrame,
        order: Column | None,
        verdicts: DataFrame,
        tally: dict[tuple[str, bool], int],
        refresh: bool,
    ) -> DataFrame:
        """The records that are to be stored, one per id.

        Records whose id comes once, and is new or was fetched earlier, are taken as they are; only
        the others are put in order or compared with what is stored.
        """
        again = F.col("repeated") | (F.col("state") == _SAME)
        set_apart = verdicts.filter(again | (F.col("state") == _STALE)).select("ticket_id")
        fresh = with_id
        if all(repeated or state in (_SAME, _STALE) for state, repeated in tally):
            fresh = with_id.limit(0)
        elif any(repeated or state in (_SAME, _STALE) for state, repeated in tally):
            fresh = with_id.join(set_apart, "ticket_id", "left_anti")
        if any(state != _STALE and (repeated or state == _SAME) for state, repeated in tally):
            asked = verdicts.filter(again & (F.col("state") != _STALE)).select("ticket_id")
            one = ingest.one_per_id(with_id.join(asked, "ticket_id", "left_semi"), order, last=refresh)
            same = verdicts.filter(F.col("state") == _SAME).select("ticket_id")
            if any(state == _SAME for state, _ in tally):
                held = self.rows(tenant).select("ticket_id", F.col("raw").alias("held_raw"))
                held = held.join(same, "ticket_id", "left_semi").withColumn("same", F.lit(True))
                differs = F.to_json("held_raw") != F.to_json(_variant(F.col("raw")))
                one = one.join(held, "ticket_id", "left").filter(F.col("same").isNull() | differs)
            fresh = fresh.unionByName(one.select(*with_id.columns))
        return fresh

    def _write(self, tenant: str, rows: DataFrame, mode: str, n_rows: int) -> None:
        """Rows into the folders of their buckets.

        Few rows are put together by bucket first; of many, every task has enough for files of its own.
        """
        spread = rows.withColumn("tenant_id", F.lit(tenant))
        if n_rows <= _FEW:
            spread = spread.hint("rebalance", "id_bucket")
        # A writer open for each bucket spares the sort of a task's rows by bucket.
        writers = "spark.sql.maxConcurrentOutputFileWriters"
        kept = self.spark.conf.get(writers)
        self.spark.conf.set(writers, str(max(int(kept), min(self.buckets, _MOST_WRITERS))))
        try:
            (
                spread.write.mode(mode)
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd")
                .partitionBy("tenant_id", "id_bucket")
                .parquet(self.path)
            )
        finally:
            self.spark.conf.set(writers, kept)

    def _replace(self, tenant: str, batch: DataFrame, gone: DataFrame, n_rows: int) -> None:
        """Write the buckets of the batch anew: its rows, and stored rows but those that it replaces.

        These are ``gone`` (ticket_id, file, at). They are marked by a bit for each row of a file, so that the others need not be shuffled: what is
        compared with the marks stays where it is read. Spark writes the new files in full beside the old
        ones before these go.
        """
        changed = _distinct(batch, "id_bucket")
        if not changed:
            return
        number = F.col("at") + 1  # bitmaps count from 1
        piece = F.bitmap_bucket_number(number).alias("piece")
        marks = self._staged(
            gone.groupBy(self._bucket(), "file", piece).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("marks")
            )
        )
        bit = F.bitmap_bit_position(number)
        byte = F.conv(F.hex(F.substring("marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.getbit(byte, (bit % 8).cast("int"))
        placed = self.met(tenant, changed).select("*", *[F.col(c).alias(name) for name, c in _PLACE.items()])
        untouched = placed.withColumn("piece", F.bitmap_bucket_number(number)).join(
            marks, ["id_bucket", "file", "piece"], "left"
        ).filter(F.col("marks").isNull() | (marked == 0))
        self._write(tenant, untouched.select(*batch.columns).unionByName(batch), "overwrite", n_rows)

    def clear(self, tenant: str) -> None:
        """Drop the tenant's rows by writing empty partitions in their place."""
        empty = self.spark.createDataFrame([], T.StructType([*SCHEMA.fields, _LAYOUT[1]]))
        folder = f"{self.path}/tenant_id={checked_tenant(tenant)}"
        noted = self._noted(tenant)
        empty.write.mode("overwrite").partitionBy("id_bucket").parquet(folder)
        self._note(tenant, dict.fromkeys(noted, 0))


def _distinct(rows: DataFrame, column: str) -> list[int]:
    """The buckets that occur, at most as many as the table has."""
    return sorted(r[0] for r in rows.select(column).distinct().collect())


def _per_bucket(rows: DataFrame) -> dict[int, int]:
    counts = rows.groupBy("id_bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r["id_bucket"]: r["n"] for r in counts.collect()}

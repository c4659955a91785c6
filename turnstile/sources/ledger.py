"""The door ledger: batches of door sales, laid out by tenant."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import constants as C
from turnstile import schema as S
from turnstile.session import written
from turnstile.sources import ingest
from turnstile.sources.store import checked_tenant


def conform(entries: DataFrame) -> DataFrame:
    """Entries with the ledger's columns and types; what is missing is null."""
    columns = []
    for field in S.LEDGER.fields:
        known = field.name in entries.columns
        col = F.col(field.name) if known else F.lit(None)
        columns.append(col.cast(field.dataType).alias(field.name))
    return entries.select(*columns)


def is_valid() -> Column:
    """The table's constraints: a known origin and no null key figures."""
    return (
        F.coalesce(F.col("source").isin(C.LEDGER_ORIGINS), F.lit(False))
        & F.col("event_name").isNotNull()
        & F.col("tickets").isNotNull()
        & F.col("revenue_brl").isNotNull()
    )


_KEY = "entry_key"
_STORED = type(S.LEDGER)([*S.LEDGER.fields, T.StructField(_KEY, T.StringType())])


def _keyed(entries: DataFrame, batch: str) -> DataFrame:
    """Entries with a key made of the batch, all they hold, and which of their equals they are.

    Equal entries of a batch are counted and told apart by number, so none is lost and no
    group of them is gathered.
    """
    columns = entries.columns
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    counted = entries.withColumn("content", F.sha2(F.concat(F.lit(f"{batch}\n"), text), 256))
    counted = counted.groupBy("content").agg(
        F.first(F.struct(*columns)).alias("entry"), F.count(F.lit(1)).alias("n")
    )
    numbered = counted.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return numbered.select("entry.*", F.concat_ws("-", "content", "number").alias(_KEY))


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> LedgerStore:
        empty = self.spark.createDataFrame([], _STORED)
        empty.write.mode("append").partitionBy("tenant_id").parquet(self.path)
        return self

    def append(
        self, tenant: str, entries: DataFrame, quarantine: str | None = None, batch: str = ""
    ) -> None:
        """Append the valid entries; the others go to the ``quarantine`` folder.

        An entry is known by its content, its time of adding included, and by the name of
        its ``batch``: what is appended again adds nothing, neither here nor there. Equal
        entries of one call are that many entries; the same entries meant once more need
        another time or batch name. The input is read once.
        """
        mine = conform(entries).withColumn("tenant_id", F.lit(checked_tenant(tenant)))
        offered = written(_keyed(mine, batch).withColumn("valid", is_valid()), "ledger_batch")
        held = ingest.tenant_rows(self.spark, self.path, tenant, _STORED).select(_KEY)
        fresh = offered.filter("valid").drop("valid").join(held, _KEY, "left_anti")
        fresh.select(*_STORED.fieldNames()).write.mode("append").partitionBy("tenant_id").parquet(self.path)
        if quarantine is not None:
            refused = offered.filter("NOT valid").drop("valid").select(*_STORED.fieldNames())
            try:
                before = self.spark.read.schema(_STORED).parquet(quarantine).select(_KEY)
                refused = refused.join(before, _KEY, "left_anti").select(*_STORED.fieldNames())
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
            refused.write.mode("append").parquet(quarantine)

    def load(self, tenant: str) -> DataFrame:
        """The tenant's entries in the order they were added; an empty price list is none.

        A batch shares its time, so the order goes on with other columns: a range sort can
        then part the batch.
        """
        prices = F.when(F.size("prices") > 0, F.col("prices"))
        own = ingest.tenant_rows(self.spark, self.path, checked_tenant(tenant), S.LEDGER)
        rows = own.withColumn("prices", prices)
        return rows.orderBy("added_at", "event_name", "entry_date", "tickets", "revenue_brl")

    def clear(self, tenant: str) -> None:
        fields = [f for f in _STORED.fields if f.name != "tenant_id"]
        empty = self.spark.createDataFrame([], type(S.LEDGER)(fields))
        folder = f"{self.path}/tenant_id={checked_tenant(tenant)}"
        empty.write.mode("overwrite").parquet(folder)

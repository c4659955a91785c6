"""Incremental intake of ticket records: what is new, what is rejected, and how much."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstile import schema as S
from turnstile.functions.normalise import decimal_cents

NO_ID = "no ticket_id"
FRACTIONAL = "fractional cents"


def of_tenant(rows: DataFrame, tenant) -> DataFrame:
    """The rows of one tenant; a partition filter where the table is laid out by tenant."""
    return rows.filter(F.col("tenant_id") == F.lit(tenant))


def tenant_rows(spark: SparkSession, path: str, tenant: str, schema: StructType) -> DataFrame:
    """One tenant's rows, read from its folder alone: other tenants' files are not even listed."""
    reader = spark.read.schema(schema).option("basePath", path)
    try:
        return reader.parquet(f"{path}/tenant_id={tenant}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def quarantine(rejected: DataFrame, path: str) -> None:
    """Append rejected records that the folder does not hold yet, by their whole content."""
    spark = rejected.sparkSession
    content = F.sha2(F.to_json(F.struct(*rejected.columns), {"ignoreNullFields": "false"}), 256)
    fresh = rejected.withColumn("content", content).dropDuplicates(["content"])
    try:
        held = spark.read.schema(fresh.schema).parquet(path).select("content")
        fresh = fresh.join(held, "content", "left_anti").select(*fresh.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)


def reject_reason(batch: DataFrame) -> Column:
    """Why a record cannot be stored, or null: it needs a key and whole cents."""
    dtypes = {f.name: f.dataType for f in batch.schema.fields}
    no_id = F.col("ticket_id").isNull() if "ticket_id" in dtypes else F.lit(True)
    fractional = F.lit(False)
    for name in S.MONEY:
        if name in dtypes:
            amount = decimal_cents(F.col(name), dtypes[name])
            fractional = fractional | F.coalesce(amount != F.bround(amount), F.lit(False))
    return F.when(no_id, NO_ID).when(fractional, FRACTIONAL)


def split_rejected(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected), the rejected ones with their reason."""
    marked = batch.withColumn("reject_reason", reject_reason(batch))
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def one_per_id(batch: DataFrame, order: Column | None = None, last: bool = False) -> DataFrame:
    """One record per ticket id: the first (or last) by ``order``, or else by content."""
    others = [c for c in batch.columns if c != "ticket_id"]
    if not others:
        return batch.distinct()
    record = F.struct(*others)
    by = order if order is not None else F.to_json(record)
    pick = F.max_by if last else F.min_by
    one = batch.groupBy("ticket_id").agg(pick(record, by).alias("record"))
    return one.select("ticket_id", "record.*").select(*batch.columns)


def new_tickets(batch: DataFrame, stored: DataFrame, order: Column | None = None) -> DataFrame:
    """Records of the batch whose id is not stored yet, one per id."""
    return one_per_id(batch, order).join(stored.select("ticket_id"), "ticket_id", "left_anti")


def incremental_counts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: ids the batch would add, and rows stored before it.

    Only numbers are asked for, so ids of both sides are counted together in one
    shuffle instead of being deduplicated and joined.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    incoming = batch.filter(F.col("ticket_id").isNotNull()).select(
        "ticket_id", one.alias("incoming"), zero.alias("existing")
    )
    known = stored.select("ticket_id", zero.alias("incoming"), one.alias("existing"))
    per_id = (
        incoming.unionByName(known)
        .groupBy("ticket_id")
        .agg(F.max("incoming").alias("incoming"), F.sum("existing").alias("existing"))
    )
    return per_id.agg(
        F.count_if((F.col("incoming") == 1) & (F.col("existing") == 0)).alias("n_new"),
        F.coalesce(F.sum("existing"), zero).alias("n_existing"),
    )

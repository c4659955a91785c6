"""Session settings the metrics rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Calendar parts (order date, hour, weekday) are defined in UTC; the rest is the cluster's."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("turnstile")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as the cluster names it; None where unset.

    The session's setting counts first, then the context's checkpoint folder (which tests set).
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    shared = shared_dir(spark)
    if not shared:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, every job's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.

    Whatever is asked for again is computed again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if kept is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, kept)
